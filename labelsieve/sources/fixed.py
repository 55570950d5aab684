"""Fixed values that results depend on: phrase lists, rule characters, severities. Dictionaries are parameters instead."""

# Fixed values, in their natural order.
SECTION_STARTS = ["配料表", "配料", "原料", "主要原料", "主要成分", "原材料", "原辅料", "成份", "ingredients", "Ingredients", "INGREDIENTS"]
SECTION_STARTS_NONFOOD = ["全成分", "主要成分", "产品主要原料", "主要原料", "成分", "成份", "原料", "Ingredients", "INGREDIENTS", "ingredients"]
SECTION_ENDS = [
    "供应商全名", "供应商", "生产许可证", "食品生产许可证", "监督电话", "物价员", "净含量", "规格", "产品标准号", "产品标准代号", "执行标准", "产品标准", "保质期", "生产日期",
    "贮存条件", "储存条件", "储存方法", "贮存方法", "生产者", "生产商", "制造商", "委托方", "被委托方", "委托生产", "生产企业", "地址", "电话", "产地", "营养成分表", "营养成分",
    "营养信息", "食用方法", "食用方式", "过敏原信息", "过敏原", "致敏物质", "致敏原", "包装", "条码", "联系方式", "客服", "客户服务", "投诉", "售后", "出品",
    "监制", "经销", "经销商", "进口商", "原产国", "原产地", "温馨提示", "注意", "警示", "适宜人群", "不适宜人群", "郑重声明", "阴凉干燥", "避光", "冷藏", "常温",
    "日期见", "见包装", "喷码", "封口处", "质量等级", "产品类型", "产品种类", "口味", "SC1", "SC2", "SC3", "SC4", "QS", "GB/T", "GB ",
    "本企业", "本公司", "本产品", "有限公司", "公司", "企业", "欢迎", "咨询", "扫码", "关注", "微信", "官网", "网址", "www.", "http", "400-", "800-", "品牌", "商标", "荣誉",
    "诚信", "致力", "精选", "传承", "注:", "注：", "备注", "食品生产许可", "儿童", "项目", "能量", "每100克", "营养素参考值",
]
PORK = ["猪", "豬", "豚"]
SPECIES = {
    "鸡": "chicken", "雞": "chicken", "鸭": "duck", "鴨": "duck", "鹅": "goose", "鵝": "goose", "牛": "beef / cattle", "羊": "mutton / sheep / goat",
    "鹿": "deer", "兔": "rabbit", "鸽": "pigeon", "鴿": "pigeon", "驼": "camel", "駝": "camel",
}
FORBIDDEN_ANIMALS = {"狗": "dog", "驴": "donkey", "驢": "donkey", "蛙": "frog", "蛇": "snake"}
BLOOD_PREFIX = ["猪", "豬", "鸭", "鴨", "鸡", "雞", "牛", "羊", "鹅", "鵝", "鹿", "兔"]
MEAT_PLANT_PREFIX = list("果椰瓜枣棗莓桃杏李梅枝圆眼楂薯豆菌菇蕉橙橘柚柑笋藕菜芒梨柿榴莲蓉素鱼魚虾蝦蟹贝貝鲍蛤螺")
MEAT_PLANT_SUFFIX = list("桂蔻豆苁碱质感色眼")
BLOOD_SKIP = list("糯橙糖藤压脂管")
BONE_SKIP, BONE_SKIP_BEFORE = list("质骼密架干气感子"), list("鱼魚软")
LIQUOR_SKIP = list("石店精")
SPECIES_SKIP = list("蛋奶乳梨蒡至膝磺角轧")
RULE_EXCEPTIONS = ["蛇果", "驴打滚"]
ADDRESS = "[省市区县镇乡路街村号巷弄楼室园]"
SEPARATORS = "、，,;；。.·•/／|｜()（）[]【】<>《》「」『』:：\n\r\t "
NEGATIONS = "不主动添加|不另外添加|不会添加|不添加|未添加|无添加|零添加|不含有|不含|不加|零|无"
UNIT_AFTER = r"^\s*(?:年|月|日|克|g|G|mg|毫克|微克|μg|ug|kJ|千焦|kcal|千卡|%|％|ml|mL|毫升|L|升|mm|cm|kg|千克|斤|个|包|袋|片|粒|℃|度|元|天|小时|分钟)"
FOOD_MARK = r"配料[:：表]|营养成分|食用方法|食品生产许可|SC\d{12,}"
PACK_SIZE = r"\d+\s*mm\s*[x×X*]\s*\d+\s*mm|净含量[:：]?\s*\d+\s*[张片抽]|\d+\s*[张片抽]\s*[/／]\s*[包片袋]"
ALCOHOL_MARK = r"(?i)酒精度|%\s*vol|vol\s*%|ABV|alc\.?\s*\d|酒精含量"
FIELD_START = "^(配料|主要成分|主要原料|原料|原材料|成份|营养|致敏|过敏|产地|规格|保质期|生产|净含量|储存|贮存|食用|执行|产品标准|地址|电话|价格|等级|计价|供应商|监督|物价|星星)"
STRUCTURED = "过敏原|致敏|产地|净含量|价格|保质期|供应商|生产许可"
ANCHOR = "配料|原料|成份|主要成分"
SEVERITY = {
    "haram": 6, "likely": 5, "animal": 5, "doubtful": 4, "unsure": 4, "meat": 4, "school": 3, "caution": 2, "review": 1,
    "seafood": 0, "note": 0, "alcohol": 0, "ok": 0, "positive": 0, "veg": 0,
}
PRODUCT_SEVERITY = {"haram": 6, "likely": 5, "doubtful": 4, "meat": 4, "caution": 2, "clean": 0}
PRODUCT_SEVERITY_NONFOOD = {"haram": 6, "animal": 5, "caution": 2, "clean": 0}
LEVEL_RANK = {"haram": 5, "likely": 4, "doubtful": 3, "caution": 2, "clean": 1, "unknown": 0}
STATUS_LABELS = {
    "haram": "forbidden", "likely": "probably forbidden", "doubtful": "source unverified", "meat": "permitted species, slaughter unverified",
    "school": "schools differ", "caution": "minor point", "review": "look into sub-ingredients", "seafood": "seafood other than fish", "note": "remark",
    "ok": "fine", "positive": "halal mark", "veg": "vegetarian mark", "animal": "from animals", "unsure": "animal or plant source", "alcohol": "alcohol, accepted in non-food",
}
LEVEL_COLORS = {"haram": "#c62828", "likely": "#c62828", "doubtful": "#ef6c00", "caution": "#f9a825", "clean": "#2e7d32", "unknown": "#616161"}
BY_TYPE_COLOR = "#558b2f"
