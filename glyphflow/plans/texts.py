"""Han texts for the registered queries, made from the documents' own texts.

The driver's tables hold no Han text. Each document's is one of SEEDS, then its
whole text with every letter written as a Han character of one script; frequent
pairs of letters spell dictionary phrases. Spark and SQL make them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS = [
    "裏面純喫茶喫飯，請你喫完再走", "他感染了A型肝炎", "A型肝炎在羣衆中傳播", "我買了新的滑鼠很好用", "弁護士と弁当と予備の万年筆", "国際電話の会議に参与する", "鄰居着急地爲衆人說話", "核心內容與軟體網路",
    "hello world 123", "", "這裏的臺灣羣島，那裡的台灣群島", "線上遊戲的伺服器設定", "他去了西維珍尼亞州", "𠮷野家の牛丼，並盛\n二つ", "脣齒相依，牀前明月光", "爲什麼，為甚麼", "汉字计算机软件打印机", "床前的粧奩，鉢裡的麪",
    "東京都の学校で体験する", "資訊科技與程式設計", "SQL注入攻擊", "煙囪與香菸，才剛纔說", "戲院の戯曲、演劇の沢山", "123漢字abc着裝，着陸",
]

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One character for each of LETTERS.
ALPHABETS = {
    "traditional": "爲衆硬裏滑羣茶體純麪着程臺喫資牀鍼鼠線軟訊脣説鉢式癡床啓僞峯棱檐污洩潙痺皁祕竈糉纔參衞覈踊針鮎齶隻雲後乾",
    "simplified": "干里台部鼠汉面件头叶松皇国发信风征标复软息谷只历后系万与专业丛东丝丢两严丧个丰临为丽举么义乌乐乔习乡书买",
    "japanese": "国万両与士亜は護予乱並学が備会乗亀沢体弁当伝内参の唇台湾為煙粧群装説験麺戯撃歯才価仏仮弥徳応恵悪戦払拝黒",
}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def seed(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.array(*map(F.lit, SEEDS)), (key % len(SEEDS)).cast("int") + 1)


def seed_sql(key: str) -> str:
    return f"list_extract([{', '.join(map(quoted, SEEDS))}], ({key} % {len(SEEDS)})::INT + 1)"


def han(script: str) -> Column:
    return F.concat(seed("doc_id"), F.translate(F.coalesce("text", F.lit("")), LETTERS, ALPHABETS[script]))


def han_sql(script: str) -> str:
    return f"{seed_sql('doc_id')} || translate(coalesce(text, ''), {quoted(LETTERS)}, {quoted(ALPHABETS[script])})"


#: Scripts by doc_id modulo 4, for detection; the fourth keeps its Latin letters.
MIXED = ("traditional", "simplified", "japanese")


def mixed() -> Column:
    out = F.concat(seed("doc_id"), F.coalesce("text", F.lit("")))
    for k, script in enumerate(MIXED):
        out = F.when(F.col("doc_id") % 4 == k, han(script)).otherwise(out)
    return out


def mixed_sql() -> str:
    cases = " ".join(f"WHEN doc_id % 4 = {k} THEN {han_sql(script)}" for k, script in enumerate(MIXED))
    return f"CASE {cases} ELSE {seed_sql('doc_id')} || coalesce(text, '') END"


def documents(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """(doc_id, lang, source, han) of all documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", text.alias("han"))
