"""A compact lexicon of our own for demonstrations, queries and tests. Real jobs pass their own tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from labelsieve.sources.tables import Lexicon, build_nonfood_dictionary, load_codes, load_dictionary, load_products, local_table

DICTIONARY = """
猪肉|haram|pork|zhūròu|pork|;猪油|haram|lard|zhūyóu|pork|;酒精|haram|alcohol|jiǔjīng|alcohol|;料酒|haram|cooking wine|liàojiǔ|alcohol|;明胶|doubtful|gelatin|míngjiāo|gelatin|animal source unstated
肉松|likely|meat floss|ròusōng|meat|;肉丸|likely|meatball|ròuwán|meat|;香肠|likely|sausage|xiāngcháng|meat|;鸭肉松|meat|duck floss|yāròusōng|meat|;牛肉|meat|beef|niúròu|meat|;鸡肉|meat|chicken|jīròu|meat|
鸡|meat|chicken|jī|meat|;虾|seafood|shrimp|xiā|seafood|;鱿鱼|seafood|squid|yóuyú|seafood|;鱼肉|ok|fish meat|yúròu|seafood|;鱼|ok|fish|yú|seafood|;甲壳素|school|chitin|jiǎqiàosù|seafood|
食用香精|caution|flavouring|shíyòngxiāngjīng|flavour|;香精|caution|flavour|xiāngjīng|flavour|;起酥油|caution|shortening|qǐsūyóu|fat|;复合调味料|review|compound seasoning|fùhétiáowèiliào|sauce|
酵母|note|yeast|jiàomǔ||;清真|positive|halal|qīngzhēn||;HALAL|positive|halal|||;Halal|positive|halal|||;halal|positive|halal|||;素食|veg|vegetarian|sùshí||;生牛乳|ok|raw milk|shēngniúrǔ||;牛乳|ok|milk|niúrǔ||
白砂糖|ok|sugar|báishātáng||;食用盐|ok|salt|shíyòngyán||;小麦粉|ok|wheat flour|xiǎomàifěn||;植物油|ok|vegetable oil|zhíwùyóu||;水|ok|water|shuǐ||;椰子水|ok|coconut water|yēzishuǐ||;肉桂|ok|cinnamon|ròuguì||
果肉|ok|fruit pulp|guǒròu||;面包|ok|bread|miànbāo||;巧克力|ok|chocolate|qiǎokèlì||;乳化剂|ok|emulsifier|rǔhuàjì||;增稠剂|ok|thickener|zēngchóujì||;单,双甘油脂肪酸酯|doubtful|mono- and diglycerides||fat|;L-肉碱|caution|L-carnitine|||
胶原蛋白|doubtful|collagen|jiāoyuándànbái|gelatin|;淀粉|ok|starch|diànfěn||;鸡蛋|ok|egg|jīdàn||;甘油|caution|glycerin|gānyóu||;乳清粉|caution|whey|rǔqīngfěn||;大豆|ok|soybean|dàdòu||
"""
NONFOOD = "甘油|unsure|glycerin|gānyóu||;羊毛脂|animal|lanolin|yángmáozhī||;小猪佩奇|ok|a cartoon pig|||;水杨酸|ok|salicylic acid|||;无纺布|ok|nonwoven fabric|||"
CODES = """
100|姜黄素|curcumin|ok|;120|胭脂虫红|carmine|doubtful|insects;124|胭脂红|ponceau 4R|ok|;322|卵磷脂|lecithin|ok|;407|卡拉胶|carrageenan|ok|;412|瓜尔胶|guar gum|ok|;415|黄原胶|xanthan gum|ok|;428|明胶|gelatin|doubtful|
441|明胶|gelatin|doubtful|;471|单双甘油脂肪酸酯|mono- and diglycerides|caution|fatty acids of any source;472e|双乙酰酒石酸|DATEM|caution|;920|半胱氨酸|cysteine|likely|hair or feathers;904|虫胶|shellac|caution|;160|胡萝卜素|carotenes|ok|
"""
PRODUCTS = """
面包|caution|bread|flour, shortening|;巧克力|caution|chocolate|cocoa, milk|;火腿肠|火腿|likely|ham sausage|pork|;牛肉干|doubtful|beef jerky|beef|;肉干|likely|meat jerky|pork|;CUSTARD PIE|派|caution|custard pie|eggs, shortening|;橡皮糖|软糖|doubtful|gummies|gelatin|;绿茶|茶|clean|tea|tea|
啤酒|haram|beer|barley, alcohol|;酸奶|meat|yogurt|milk, gelatin|
"""
PRODUCTS_NONFOOD = "湿巾|clean|wet wipes|water|;香皂|caution|soap|tallow or palm|;羊绒皂|animal|wool soap|lanolin|"
STRONG = ["湿巾", "洗发", "沐浴", "护肤", "牙膏", "纸巾", "面膜", "香皂"]
WEAK = ["皮肤", "清洁", "外用", "滋润", "皮肤"]


def _rows(text: str, width: int) -> list[list[str]]:
    return [x.split("|") for line in text.strip().split("\n") for x in line.split(";") if x.strip()] if width == 0 else [(x.split("|") + [""] * width)[:width] for line in text.strip().split("\n") for x in line.split(";") if x.strip()]


def _products(spark: SparkSession, text: str):
    levels = {"haram", "likely", "doubtful", "meat", "caution", "clean", "animal"}
    rows = []
    for k, x in enumerate(_rows(text, 0)):
        at = next(i for i, v in enumerate(x) if v in levels)
        rows.append((k, "|".join(x[:at]), *(x[at:] + ["", ""])[:4]))
    return load_products(local_table(spark, rows, "ord int, names string, level string, en string, typical string, note string"))


def lexicon(spark: SparkSession) -> Lexicon:
    schema = "ord int, term string, status string, en string, py string, category string, note string"
    food = load_dictionary(local_table(spark, [(k, *x) for k, x in enumerate(_rows(DICTIONARY, 6))], schema))
    over = load_dictionary(local_table(spark, [(k, *x) for k, x in enumerate(_rows(NONFOOD, 6))], schema))
    codes = load_codes(local_table(spark, _rows(CODES, 5), "code string, name_zh string, name_en string, status string, note string"))
    return Lexicon(food, build_nonfood_dictionary(food, over), codes, _products(spark, PRODUCTS), _products(spark, PRODUCTS_NONFOOD), STRONG, WEAK)
