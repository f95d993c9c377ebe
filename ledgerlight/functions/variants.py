"""Variant kanji and their usual forms, 364 of the Unihan database (LICENSE-Unicode.txt) and 4 added by hand."""

# fmt: off
_OLD = (
    "乘亂亞佛來倂假傳僞價儉兒兩剩劍劑勞勳勵勸區卷卽參單嚴囑圈國圍圓圖團增墮壓壘壞壤壯"
    "壹壽奧奬孃學寢實寫寬寶將專對屆屬峽嵜嶽巢帶廢廣廳彈彌徑從徵德恆惠惡惱愼慘應懷戀戰"
    "戲戾拂拔拜挾插揭搖搜擇擊擔據擧擴攝收效敍敕數斷晚晝曆曉曾會條棧榮槪樂樓樞樣橫檢櫻"
    "權歐歡步歷歸殘殼毆每氣涉淚淨淺渴溪溫滯滿潛澁澤濕濟濱瀧瀨灣燈燒營爐爭爲犧狀狹獨獵"
    "獸獻瓣甁畫當疊瘦癡發盜盡眞硏碎祕禪禮稱稻穗穩竊竝粹絲經綠緖緣縣縱總繩繪繼續纖缺罐"
    "聲聽肅腦膽臟臺與舊艷莊莖萬薰藏藝藥處虛號螢蟲蠶蠻衞裝襃覺覽觀觸謠證譯譽讀變讓豐豫"
    "貳賣賴贊踐輕轉辨辭辯遞遲邉邊郞鄕醉醫釀釋錄錢鍊鎭鐵鑄鑛關陷隨險隱雙雜霸靈靜顯飜餘"
    "餠騷驅驗驛髓體髙髮鬭鷄鹽麥麵黃黑默點黨齊齋齒齡龍龜\uF91D\uF928\uF929\uF936\uF970\uF9D0\uF9DC\uFA10\uFA11\uFA19\uFA1A\uFA1B\uFA22\uFA26\uFA30"
    "\uFA31\uFA32\uFA33\uFA34\uFA35\uFA36\uFA37\uFA38\uFA39\uFA3A\uFA3B\uFA3D\uFA3E\uFA3F\uFA40\uFA41\uFA42\uFA43\uFA44\uFA45\uFA47\uFA48\uFA4B\uFA4C\uFA4D\uFA4E\uFA50\uFA51\uFA52\uFA54\uFA55\uFA56\uFA57\uFA59\uFA5A\uFA5B\uFA5C\uFA5F\uFA60\uFA61"
    "\uFA62\uFA63\uFA64\uFA65\uFA67\uFA68\uFA69\uFA6A"
)
_USUAL = (
    "乗乱亜仏来併仮伝偽価倹児両剰剣剤労勲励勧区巻即参単厳嘱圏国囲円図団増堕圧塁壊壌壮"
    "壱寿奥奨嬢学寝実写寛宝将専対届属峡崎岳巣帯廃広庁弾弥径従徴徳恒恵悪悩慎惨応懐恋戦"
    "戯戻払抜拝挟挿掲揺捜択撃担拠挙拡摂収効叙勅数断晩昼暦暁曽会条桟栄概楽楼枢様横検桜"
    "権欧歓歩歴帰残殻殴毎気渉涙浄浅渇渓温滞満潜渋沢湿済浜滝瀬湾灯焼営炉争為犠状狭独猟"
    "獣献弁瓶画当畳痩痴発盗尽真研砕秘禅礼称稲穂穏窃並粋糸経緑緒縁県縦総縄絵継続繊欠缶"
    "声聴粛脳胆臓台与旧艶荘茎万薫蔵芸薬処虚号蛍虫蚕蛮衛装褒覚覧観触謡証訳誉読変譲豊予"
    "弐売頼賛践軽転弁辞弁逓遅辺辺郎郷酔医醸釈録銭錬鎮鉄鋳鉱関陥随険隠双雑覇霊静顕翻余"
    "餅騒駆験駅髄体高髪闘鶏塩麦麺黄黒黙点党斉斎歯齢竜亀欄廊朗虜殺類隆塚崎神祥福諸都侮"
    "僧免勉勤卑喝嘆器塀墨層悔慨憎懲敏既暑梅海漢煮碑社祉祈祖祝禍穀突節練繁署者臭著褐視"
    "謁謹賓贈逸難響頻"
)
# fmt: on
VARIANTS = dict(zip(_OLD, _USUAL, strict=True))
