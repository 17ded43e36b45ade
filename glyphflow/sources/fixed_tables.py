"""The small dictionaries, whole.

Entries are those of the public Chinese-variant dictionaries of the OpenCC
project (https://github.com/BYVoid/OpenCC, commit
cf0e4b6c0e0ec4c9f55a3a5884ba8c292dbe5489), Apache License, Version 2.0.
"""

# Results depend on them as they stand (key, tab, values).
FIXED = {
    "TWVariants": """
僞	偽
啓	啟
喫	吃
嫺	嫻
嬀	媯
峯	峰
幺	么
棱	稜
檐	簷
污	汙
泄	洩
潙	溈
潨	潀
爲	為
牀	床
痹	痺
癡	痴
皁	皂
着	著
睾	睪
祕	秘
竈	灶
糉	粽
繮	韁
纔	才
羣	群
脣	唇
蔘	參
蔿	蒍
衆	眾
裏	裡
覈	核
踊	踴
鉢	缽
鍼	針
鮎	鯰
麪	麵
齶	顎
""",
    "TWVariantsPhrases": """
喫茶小舖	喫茶小舖
牛驥同一皁	牛驥同一皁
牛驥同皁	牛驥同皁
純喫茶	純喫茶
""",
    "HKVariants": """
僞	偽
兌	兑
叄	叁
只	只 衹
啓	啓 啟
喫	吃
囪	囱
妝	妝 粧
媼	媪
嬀	媯
悅	悦
慍	愠
戶	户
# @reverse-prefer: 才
才	才
挩	捝
搵	揾
敓	敚
敘	敍 敘
柺	枴
# @reverse-prefer: 核
核	核
梲	棁
棱	稜 棱
榲	榅
檯	枱
氳	氲
涗	涚
溫	温
溼	濕
潙	溈
潨	潀
# @reverse-prefer: 煙
煙	煙
熅	煴
爲	為
癡	痴
皁	皂
祕	秘
稅	税
竈	灶
糉	粽 糉 糭
線	線 綫
縕	緼
纔	才 纔
脣	唇
脫	脱
膃	腽
臥	卧
臺	台
菸	煙 菸
蒕	蒀
蔥	葱
蔿	蒍
蘊	藴
蛻	蜕
衆	眾
衛	衞
覈	核 覈
說	説
踊	踴
轀	輼
醞	醖
鉢	缽
鉤	鈎
銳	鋭
鍼	針
閱	閲
鰮	鰛
""",
    "HKPhrases": """
伊利諾伊	伊利諾
伊利諾伊州	伊利諾州
俄克拉何馬	奧克拉荷馬
俄克拉何馬州	奧克拉荷馬州
俄克拉荷馬	奧克拉荷馬
俄克拉荷馬州	奧克拉荷馬州
光標	游標
北卡羅來納	北卡羅萊納
北卡羅來納州	北卡羅萊納州
南卡羅來納	南卡羅萊納
南卡羅來納州	南卡羅萊納州
密歇根	密芝根
密歇根州	密芝根州
寬帶	寬頻
幾率	機率 概率
弗吉尼亞	維珍尼亞
弗吉尼亞州	維珍尼亞州
得克薩斯	德薩斯
得克薩斯州	德薩斯州
德克薩斯	德薩斯
德克薩斯州	德薩斯州
搜索	搜尋
操作系統	作業系統
文件夾	資料夾
服務器	伺服器
概率	概率 機會率
硬盤	硬碟
編程語言	程式語言
羅得島	羅德島
羅得島州	羅德島州
西弗吉尼亞	西維珍尼亞
西弗吉尼亞州	西維珍尼亞州
賓夕法尼亞	賓夕凡尼亞
賓夕法尼亞州	賓夕凡尼亞州
隱私權	私隱權
馬里蘭	馬利蘭
馬里蘭州	馬利蘭州
鼠標	滑鼠
""",
    "HKPhrasesRev": """
伊利諾	伊利諾伊
伊利諾州	伊利諾伊州
伺服器	服務器
作業系統	操作系統
北卡羅萊納	北卡羅來納
北卡羅萊納州	北卡羅來納州
南卡羅萊納	南卡羅來納
南卡羅萊納州	南卡羅來納州
奧克拉荷馬	俄克拉何馬 俄克拉荷馬
奧克拉荷馬州	俄克拉何馬州 俄克拉荷馬州
密芝根	密歇根
密芝根州	密歇根州
寬頻	寬帶
德薩斯	得克薩斯 德克薩斯
德薩斯州	得克薩斯州 德克薩斯州
搜尋	搜索
概率	概率 幾率
機會率	概率
機率	幾率
游標	光標
滑鼠	鼠標
硬碟	硬盤
私隱權	隱私權
程式語言	編程語言
維珍尼亞	弗吉尼亞
維珍尼亞州	弗吉尼亞州
羅德島	羅得島
羅德島州	羅得島州
西維珍尼亞	西弗吉尼亞
西維珍尼亞州	西弗吉尼亞州
資料夾	文件夾
賓夕凡尼亞	賓夕法尼亞
賓夕凡尼亞州	賓夕法尼亞州
馬利蘭	馬里蘭
馬利蘭州	馬里蘭州
""",
    "JPShinjitaiPhrases": """
一獲千金	一攫千金
丁寧	叮嚀
丁重	鄭重
三差路	三叉路
世論	輿論
予備	預備
予告	預告
予定	預定
予感	預感
予測	預測
予算	預算
予約	預約
予習	預習
予言	預言
予防	預防
亜鈴	啞鈴
交差	交叉
代弁	代辯
供宴	饗宴
俊馬	駿馬
保塁	堡壘
個条書	箇条書
偏平	扁平
停泊	碇泊
優俊	優駿
先兵	尖兵
先端	尖端
先鋭	尖銳
共役	共軛
冗舌	饒舌
凶器	兇器
削岩	鑿岩
包丁	庖丁
包帯	繃帶
区画	區劃
厳然	儼然
友宜	友誼
反乱	叛亂
収集	蒐集
叙情	抒情
台頭	擡頭
合弁	合辦
喜遊曲	嬉遊曲
嘆願	歎願
回転	廻転
回遊	回游
国際連盟	國際聯盟
奉持	捧持
委縮	萎縮
安全弁	安全瓣
展転	輾轉
希少	稀少
幻惑	眩惑
広範	廣泛
広野	曠野
廃虚	廢墟
建坪率	建蔽率
弁別	辨別
弁当	辨當
弁才	辯才
弁明	辯明
弁膜	瓣膜
弁解	辯解
弁証	辯證
弁論	辯論
弁論家	辯論家
弁護	辯護
弁護士	辯護士
弁財天	辯財天
弁駁	辯駁
弁髪	辮髮
弦歌	絃歌
恩義	恩誼
意向	意嚮
慰謝料	慰藉料
憶断	臆斷
憶病	臆病
戦没	戰歿
扇情	煽情
手帳	手帖
技量	伎倆
抜粋	抜萃
披歴	披瀝
抵触	牴觸
抽選	抽籤
拘引	勾引
拠出	醵出
拠金	醵金
掘削	掘鑿
控除	扣除
援護	掩護
放棄	抛棄
散水	撒水
敬謙	敬虔
敷延	敷衍
断固	斷乎
族生	簇生
昇叙	陞敘
暖房	煖房
暗唱	暗誦
暗夜	闇夜
暴露	曝露
枯渇	涸渴
格好	恰好
格幅	恰幅
棄損	毀損
模索	摸索
橋頭保	橋頭堡
欠缺	欠缺
欧州	歐洲
欧州連合	歐洲聯盟
死体	屍體
殿部	臀部
母指	拇指
気迫	氣魄
決別	訣別
決壊	決潰
沈殿	沈澱
油送船	油槽船
波乱	波瀾
注釈	註釋
洗浄	洗滌 洗淨
活発	活潑
浸透	滲透
浸食	浸蝕
消却	銷卻
混然	渾然
湾曲	彎曲
溶接	熔接
漁労	漁撈
漂然	飄然
激高	激昂
火炎	火焰
焦燥	焦躁
猶予	猶豫
班点	斑點
留飲	溜飲
略奪	掠奪
疎通	疏通
発酵	醱酵
白亜	白堊
相克	相剋
知恵	智慧
破棄	破毀
確固	確乎
禁固	禁錮
符丁	符牒
粉装	扮裝
紫班	紫斑
終息	終熄
総合	綜合
編集	編輯
義援	義捐
耕運機	耕耘機
肝心	肝腎
肩甲骨	肩胛骨
背徳	悖德
脈拍	脈搏
膨張	膨脹
花弁	花瓣
芳純	芳醇
英知	叡智
蒸留	蒸溜
薫蒸	燻蒸
薫製	燻製
衣装	衣裳
衰退	衰退 衰頽
裕然	悠然
補佐	輔佐
訓戒	訓誡
試練	試煉
詭弁	詭辯
講和	媾和
象眼	象嵌
貫録	貫祿
買弁	買辦
賛辞	讚辭
踏襲	蹈襲
車両	車輛
転倒	顛倒
輪郭	輪廓
退色	褪色
途絶	杜絕
連係	連繫
連合	聯合
連合会	聯合會
連合国	聯合國
連合艦隊	聯合艦隊
連合軍	聯合軍
連名	聯名
連想	聯想
連携	聯攜
連盟	聯盟
連立	聯立
連結	聯結
連結器	聯結器
連結性	聯結性
連絡	聯絡
連絡員	聯絡員
連絡網	聯絡網
連絡線	聯絡線
連絡船	聯絡船
連邦	聯邦
連邦共和国	聯邦共和國
連邦制	聯邦制
連邦国	聯邦國
連邦国家	聯邦國家
連邦政府	聯邦政府
連邦議会	聯邦議會
連邦軍	聯邦軍
連隊	聯隊
選考	銓衡
酢酸	醋酸
野卑	野鄙
鉱石	礦石
間欠	間歇
関数	函數
関連	關聯
関連図	關聯圖
関連性	關聯性
関連語	關聯語
防御	防禦
険阻	嶮岨
障壁	牆壁
障害	障礙
隠滅	湮滅
雄弁	雄辯
集落	聚落
雇用	僱傭
風諭	諷喩
飛語	蜚語
香典	香奠
骨格	骨骼
高進	亢進
鳥観	鳥瞰
""",
    "STPhrases.patch": """
一出戏	一齣戲 一出戲
""",
}
