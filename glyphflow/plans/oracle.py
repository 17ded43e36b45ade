"""SQL for the registered queries: the same results by other means, from dictionary lines.

Dictionaries come in as their raw lines; parsing, merging, reversing, patching
and projecting are done in SQL. A text is cut by one regular expression (keys,
longest first, else one character), its pieces are joined with the entries and
put together again. SEPARATOR stands between segments, so that no key crosses
one; a segment that begins with ASCII is cut without the keys that do.
"""

from __future__ import annotations

from glyphflow.plans import configs
from glyphflow.plans.texts import quoted
from glyphflow.sources.dictionaries import Registry

SEPARATOR = "\ue000"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def lines_sql(registry: Registry, *names: str) -> str:
    return f"lines(dict, ord, line) AS (VALUES {values((n, k, x) for n in names for k, x in enumerate(registry.lines(n), 1))})"


#: All entries of lines, and of keys that repeat the last.
EACH_ENTRY = """each_entry AS (SELECT dict, ord, split_part(line, chr(9), 1) AS key, string_split(trim(regexp_replace(split_part(line, chr(9), 2), '\\s+', ' ', 'g')), ' ') AS vs FROM lines
  WHERE NOT starts_with(line, '#') AND contains(line, chr(9)) AND trim(split_part(line, chr(9), 2)) <> '')"""
ENTRIES = f"{EACH_ENTRY},\nentries AS (SELECT dict, max(ord) AS ord, key, arg_max(vs, ord) AS vs FROM each_entry GROUP BY dict, key)"


def reversed_sql(name: str) -> str:
    """(dict, ord, key, vs) of the reversed dictionary: each value with the keys that had it, a preferred one first."""
    return f"""SELECT '{name}Rev', 0, v, list(key ORDER BY CASE WHEN key = first AND nth = 1 THEN 0 ELSE 1 END, ord, pos) FROM (
  SELECT e.*, p.first, row_number() OVER (PARTITION BY v, key ORDER BY ord, pos) AS nth
  FROM (SELECT ord, key, unnest(vs) AS v, generate_subscripts(vs, 1) AS pos FROM each_entry WHERE dict = '{name}') e
  LEFT JOIN (SELECT arg_max(w[1], ord) AS v, arg_max(w[-1], ord) AS first FROM (SELECT ord, string_split(trim(regexp_replace(substr(line, 19), '\\s+', ' ', 'g')), ' ') AS w FROM lines
    WHERE dict = '{name}' AND starts_with(line, '# @reverse-prefer:')) GROUP BY w[1]) p USING (v)) GROUP BY v"""


def _tofu_sql() -> str:
    return """SELECT 'TSCharactersExt', ord, key, CASE WHEN vs[1] = key THEN vs[2:] ELSE vs END FROM each_entry JOIN (
  SELECT ord + 1 AS ord FROM lines WHERE dict = 'TSCharacters' AND starts_with(line, '# @tofu-risk:')) USING (ord) WHERE dict = 'TSCharacters'"""


def _pattern(keys) -> str:
    """Keys of several characters, longest first, else any one character."""
    several = sorted((k for k in set(keys) if len(k) > 1), key=lambda k: (-len(k), k))
    escaped = ("".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in k) for k in several)
    return quoted("|".join([*escaped, "(?s:.)"]))


def _keys(registry: Registry, names) -> list[str]:
    """The keys of lines as they stand; they only cut, what they become is joined in SQL."""
    return [line.split("\t", 1)[0] for n in names for line in configs.dictionary(registry, n) if "\t" in line and not line.startswith("#")]


_G = "STPhrases_GeneratedFromRegionalPhrases"


def _projected_sql(registry: Registry) -> str:
    """Regional phrases of three characters or more by their simplified form; here TSPhrases go before single characters."""
    pattern = _pattern(_keys(registry, ["TSPhrases"]))
    return f"""SELECT '{_G}', 0, short, [min(whole)] FROM (
  SELECT whole, string_agg(coalesce(p.vs[1], x.vs[1], c.vs[1], tok), '' ORDER BY n) AS short FROM (
    SELECT whole, unnest(t) AS tok, generate_subscripts(t, 1) AS n FROM (SELECT DISTINCT key AS whole, regexp_extract_all(key, {pattern}) AS t FROM entries WHERE dict IN ('HKPhrases', 'TWPhrases')))
  LEFT JOIN entries p ON p.dict = 'TSPhrases' AND p.key = tok LEFT JOIN (SELECT * FROM ({_tofu_sql()}) t(dict, ord, key, vs)) x ON x.key = tok
  LEFT JOIN entries c ON c.dict = 'TSCharacters' AND c.key = tok GROUP BY whole) WHERE length(short) >= 3 GROUP BY short"""


def dictionaries_sql(registry: Registry, names: list[str]) -> str:
    """known(dict, ord, key, vs): source and derived dictionaries by name."""
    sources, derived = [], []
    for n in dict.fromkeys(names):
        if n.endswith("Rev") and n[:-3] in ("TWVariants", "HKVariants", "JPShinjitaiCharacters"):
            sources.append(n[:-3])
            derived.append(reversed_sql(n[:-3]))
        elif n == "TSCharactersExt":
            sources.append("TSCharacters")
            derived.append(_tofu_sql())
        elif n == _G:
            sources += ["HKPhrases", "TWPhrases", "TSPhrases", "TSCharacters"]
            derived.append(_projected_sql(registry))
        elif n == "STPhrases":
            sources += ["STPhrases", "STPhrases.patch"]
            derived.append("SELECT 'STPhrases', ord, key, vs FROM entries WHERE dict = 'STPhrases' AND key NOT IN (SELECT key FROM entries WHERE dict = 'STPhrases.patch') UNION ALL SELECT 'STPhrases', ord + 100000000, key, vs FROM entries WHERE dict = 'STPhrases.patch'")
        else:
            sources.append(n)
            derived.append(f"SELECT dict, ord, key, vs FROM entries WHERE dict = '{n}'")
    unions = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in derived)
    return f"{lines_sql(registry, *dict.fromkeys(sources))},\n{ENTRIES},\nknown(dict, ord, key, vs) AS ({unions})"


def group_sql(name: str, dicts: list[str], custom: list[tuple[str, str]]) -> str:
    """name(k, vs): of dictionaries merged in order the last wins a key; custom words win over them."""
    rank = "CASE dict " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(dicts)) + " END"
    merged = f"SELECT key AS k, arg_max(vs, ({rank}, ord)) AS vs FROM known WHERE dict IN ({', '.join(map(quoted, dicts))}) GROUP BY key"
    if not custom:
        return f"{name} AS ({merged})"
    own = f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, [{quoted(v)}])' for k, v in dict(custom).items())}) c(k, vs)"
    return f"{name} AS ({own} UNION ALL SELECT k, vs FROM ({merged}) m WHERE k NOT IN ({', '.join(quoted(k) for k, _ in custom)}))"


def _cut_by(registry: Registry, dicts: list[str], custom: list[tuple[str, str]], ascii_too: bool = True) -> str:
    own = sorted({k for k, _ in custom if ascii_too or k[0] >= "\x80"}, key=lambda k: (-len(k), k))
    keys = [k for k in _keys(registry, dicts) if ascii_too or k[0] >= "\x80"]
    if any(k < "\x80" for k in [*own, *keys] if len(k) == 1):
        raise ValueError("single ASCII characters are joined in any segment")
    first = "".join("".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in k) + "|" for k in own)
    return "'" + first.replace("'", "''") + _pattern(keys)[1:]


def cut_sql(source: str, column: str, pattern: str) -> str:
    """Pieces (id, n, tok) of a column of texts."""
    return f"SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) AS n FROM (SELECT id, regexp_extract_all({column}, {pattern}) AS t FROM {source})"


def convert_ctes(registry: Registry, segmentation: list[str] | None, chain: list[list[str]], custom: list[tuple[str, str]] | None = None, first: list[tuple[str, str]] | None = None) -> str:
    """done(id, converted) of texts(id, han); custom words go first in every group, first is a layer of the first stage alone."""
    custom = custom or []
    names = [*(segmentation or []), *(n for g in chain for n in g)]
    out = [dictionaries_sql(registry, names)]
    if segmentation:
        out += [group_sql("seg_group", segmentation, custom), f"seg_tok AS ({cut_sql('texts', 'han', _cut_by(registry, segmentation, custom))})"]
        piece = f"CASE WHEN k IS NULL THEN tok ELSE '{SEPARATOR}' || tok || '{SEPARATOR}' END"
        out.append(f"text0 AS (SELECT id, string_agg({piece}, '' ORDER BY n) AS s FROM seg_tok LEFT JOIN seg_group ON tok = k GROUP BY id)")
    else:
        out.append("text0 AS (SELECT id, han AS s FROM texts)")
    segment_words = custom
    for k, dicts in enumerate(chain):
        custom = segment_words + (first or []) if k == 0 else segment_words
        keys = [*_keys(registry, dicts), *(c for c, _ in custom)]
        pieces = f"regexp_extract_all(s, {_cut_by(registry, dicts, custom)})"
        if any(key[0] < "\x80" for key in keys):
            each = f"CASE WHEN ascii(x) < 128 THEN regexp_extract_all(x, {_cut_by(registry, dicts, custom, False)}) ELSE regexp_extract_all(x, {_cut_by(registry, dicts, custom)}) END"
            pieces = f"flatten(list_transform(string_split(s, '{SEPARATOR}'), lambda x: list_append({each}, '{SEPARATOR}')))"
        out += [group_sql(f"group{k}", dicts, custom), f"tok{k} AS (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) AS n FROM (SELECT id, {pieces} AS t FROM text{k}))"]
        out.append(f"text{k + 1} AS (SELECT id, string_agg(coalesce(vs[1], tok), '' ORDER BY n) AS s FROM tok{k} LEFT JOIN group{k} ON tok = k GROUP BY id)")
    out.append(f"done AS (SELECT id, replace(s, '{SEPARATOR}', '') AS converted FROM text{len(chain)})")
    return ",\n".join(out)


def convert_sql(registry: Registry, config: str, han: str, custom=None) -> str:
    _, _, _, segmentation, chain = configs.CONFIGS[config]
    return f"""WITH texts AS (SELECT doc_id AS id, {han} AS han FROM documents),
{convert_ctes(registry, segmentation, chain, custom)}
SELECT id AS doc_id, coalesce(converted, '') AS converted FROM texts LEFT JOIN done USING (id)"""


def segments_sql(registry: Registry, config: str, han: str) -> str:
    segmentation = configs.CONFIGS[config][3]
    return f"""WITH texts AS (SELECT doc_id AS id, {han} AS han FROM documents),
{dictionaries_sql(registry, segmentation)}, {group_sql("seg_group", segmentation, [])},
tok AS ({cut_sql('texts', 'han', _cut_by(registry, segmentation, []))}),
met AS (SELECT id, n, tok, k IS NOT NULL AS hit FROM tok LEFT JOIN seg_group ON tok = k),
cut AS (SELECT *, CASE WHEN hit OR lag(hit, 1, true) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS starts FROM met),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY n) - 1 AS seg_no FROM cut)
SELECT id AS doc_id, seg_no::INT AS seg_no, string_agg(tok, '' ORDER BY n) AS seg, bool_or(hit) AS matched FROM numbered GROUP BY id, seg_no"""


#: Where each signature comes from: dictionary, its keys or first values, changed entries only.
_SIGNATURES = {"cn_s": ("STCharacters", "key", True), "cn_t": ("TSCharacters", "key", True), "cn_tw": ("TWVariants", "key", False), "cn_hk": ("HKVariants", "key", False), "jp_n": ("JPShinjitaiCharacters", "key", False), "jp_t": ("JPShinjitaiCharacters", "vs[1]", False)}


def tally_ctes(registry: Registry) -> str:
    """tallied(id, cjk, kana, six signatures) of texts(id, han), signatures from dictionary lines."""
    names = list(dict.fromkeys([*(d for d, _, _ in _SIGNATURES.values()), "TWPhrases", "HKPhrases"]))
    signs = ", ".join(
        f"(SELECT coalesce(string_agg(DISTINCT c, ''), '') FROM (SELECT unnest(string_split({what}, '')) AS c FROM entries WHERE dict = '{d}'{' AND vs[1] <> key' if changed else ''}) WHERE c BETWEEN '一' AND '鿿') AS s_{k}"
        for k, (d, what, changed) in _SIGNATURES.items()
    )
    counts = ", ".join(f"(length(han) - length(translate(han, s_{k}, '')))::INT AS {k}" for k in _SIGNATURES)
    return f"""{lines_sql(registry, *names)},
{ENTRIES}, signs AS (SELECT {signs}),
tallied AS (SELECT id, han, {counts}, length(regexp_replace(han, '[^一-鿿]', '', 'g'))::INT AS cjk, length(regexp_replace(han, '[^぀-ヿ]', '', 'g'))::INT AS kana FROM texts, signs)"""


def detect_ctes(registry: Registry) -> str:
    """detected(id, region, confidence) of texts(id, han)."""
    pct = lambda part, total: f"(CASE WHEN {total} = 0 THEN 0 ELSE floor({part} * 100 / {total})::INT & 255 END)"
    tw, hk = pct("(cn_t + cn_tw)", "cjk"), pct("(cn_t + cn_hk)", "cjk")
    rules = [
        ("kana > 0 AND jp_n + jp_t = 0", "jp-n", "50"),
        ("kana > 0 AND jp_n >= jp_t", "jp-n", pct("jp_n", "(jp_n + jp_t)")),
        ("kana > 0", "jp-t", pct("jp_t", "(jp_n + jp_t)")),
        ("cjk = 0", None, "NULL"),
        ("p_tw > p_hk", "cn-tw", f"greatest(50, {tw})"),
        ("p_hk > p_tw", "cn-hk", f"greatest(50, {hk})"),
        ("p_both > 0 OR p_tw > 0", "cn-tw", f"greatest(40, {tw})"),
        ("cn_s > cn_t + cn_tw + cn_hk", "cn-s", pct("cn_s", "cjk")),
        ("cn_tw >= cn_hk AND 2 * cn_tw >= cn_t + cn_tw AND cn_tw > 0", "cn-tw", tw),
        ("cn_hk > cn_tw AND 2 * cn_hk >= cn_t + cn_hk AND cn_hk > 0", "cn-hk", hk),
        ("TRUE", "cn-t", pct("(cn_t + cn_tw + cn_hk)", "cjk")),
    ]
    region = " ".join(f"WHEN {c} THEN {quoted(r) if r else 'NULL'}" for c, r, _ in rules)
    confidence = " ".join(f"WHEN {c} THEN {x}" for c, _, x in rules)
    return f"""{tally_ctes(registry)},
phrase AS (SELECT vs[1] AS p, sum(CASE WHEN dict = 'TWPhrases' THEN length(vs[1]) ELSE 0 END) AS tw, sum(CASE WHEN dict = 'HKPhrases' THEN length(vs[1]) ELSE 0 END) AS hk
  FROM entries WHERE dict IN ('TWPhrases', 'HKPhrases') AND length(vs[1]) >= 2 GROUP BY vs[1]),
scored AS (SELECT id, coalesce(sum(CASE WHEN hk = 0 THEN tw END), 0) AS p_tw, coalesce(sum(CASE WHEN tw = 0 THEN hk END), 0) AS p_hk, coalesce(sum(CASE WHEN tw > 0 AND hk > 0 THEN tw END), 0) AS p_both
  FROM texts LEFT JOIN phrase ON contains(han, p) GROUP BY id),
detected AS (SELECT id, CASE {region} END AS region, (CASE {confidence} END)::INT AS confidence FROM tallied JOIN scored USING (id))"""
