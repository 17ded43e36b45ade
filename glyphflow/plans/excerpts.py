"""Excerpts of the larger dictionaries: what the queries' own texts meet, and each one's beginning.

Entries are those of the public Chinese-variant dictionaries of the OpenCC
project (https://github.com/BYVoid/OpenCC, commit
cf0e4b6c0e0ec4c9f55a3a5884ba8c292dbe5489), Apache License, Version 2.0.
"""

# Results depend on them as they stand (key, tab, values).
EXCERPTS = {
    "TWPhrases": """
B超	超音波
PN結	PN接面
SQL注入	SQL隱碼攻擊
SQL注入攻擊	SQL隱碼攻擊
U盤	隨身碟
丁丁當	叮叮噹
丁丁當當	叮叮噹噹
丁型肝炎	D型肝炎
信息	資訊
信息技術	資訊科技
內核	核心
在線	線上
打印	列印
服務器	伺服器
甲型肝炎	A型肝炎
程序	程式
網絡	網路
編程	程式設計
設置	設定
軟件	軟體
鼠標	滑鼠
""",
    "TWPhrasesRev": """
A型肝炎	甲型肝炎
A肝	甲肝
BMW集團	寶馬集團
B型肝炎	乙型肝炎
B肝	乙肝
C型肝炎	丙型肝炎
C肝	丙肝
D型肝炎	丁型肝炎
SQL隱碼攻擊	SQL注入 SQL注入攻擊
伺服器	服務器
列印	打印
核心	內核
滑鼠	鼠標
程式	程序
程式設計	編程
網路	網絡
線上	在線
設定	設置
資訊	信息
資訊科技	信息技術
軟體	軟件
""",
    "TWVariantsRevPhrases": """
一口吃個	一口喫個
一口吃成	一口喫成
一家三口	一家三口
一家五口	一家五口
一家六口	一家六口
一家四口	一家四口
一展長才	一展長才
一流人才	一流人才
核心	核心
""",
    "HKVariantsPhrases": """
一幻拉麪	一幻拉麵
一粥麪	一粥麵
三田製麪所	三田製麵所
仙姑峯	仙姑峰
何芷姍	何芷姗
佛教茂峯法師紀念中學	佛教茂峰法師紀念中學
儒林台	儒林臺
儒林臺	儒林臺
純喫茶	純喫茶
""",
    "HKVariantsRevPhrases": """
一口吃個	一口喫個
一口吃成	一口喫成
一家三口	一家三口
一家五口	一家五口
一家六口	一家六口
一家四口	一家四口
一針	一針
一針見血	一針見血
""",
    "JPShinjitaiCharacters": """
万	萬
与	與
両	兩
並	竝
乗	乘
乱	亂
亀	龜
予	豫
亜	亞
会	會
伝	傳
体	體
内	内 內
参	參
台	臺
唇	唇 脣
国	國
学	學
床	床 牀
弁	辨 辯 瓣
当	當
戯	戲
才	才 纔
撃	擊
歯	齒
沢	澤
湾	灣
為	爲
煙	煙 菸
粧	粧 妝
群	群 羣
装	裝
説	說
験	驗
麺	麵 麪
""",
}
