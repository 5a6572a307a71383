"""Text normalisation and similarity as column expressions; NFKC alone needs a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters dropped from names before comparing them.
NAME_PUNCTUATION = r"""[「」『』【】()\[\]（）・･,，.。'"“”‘’\s_\-–—~〜/／\\]"""
#: Separators of names in a line-up, role labels before names, and entries that are no names.
NAME_SEPARATORS = r"(?i)\s*(?:/|／|、|,|，|×|\s&\s|\band\b|\bx\b)\s*"
ROLE_LABELS = r"(?i)[【［<＜](?:guest|ゲスト|出演|opening\s*act|live\s*act)[】］>＞]"
ROLE_PREFIXES = r"(?i)[■◆●・]?\s*(?:スペシャルゲスト|guest|ゲスト|opening\s*act|live\s*act|出演|vs)\s*[:：]\s*"
NOT_NAMES = r"(?i)^(?:guest|ゲスト|出演者|more(?:\.{3}|…)?|coming\s*soon(?:…|\.\.\.)?|not\s*found)$"
#: What is replaced in a line-up before it is split, in this order.
LINE_UP_RULES = (
    (r"^出演者?\s*[:：]\s*ハロプロ研修生(?=\p{IsHan})", "ハロプロ研修生 / "), (r"^出演者?\s*[:：]\s*", ""), (r"ハロプロ研修生(?=\p{IsHan})", "ハロプロ研修生 / "), (r"^(WHITE SCORPION)\s+(.+)$", "$1 / $2"),
    (r"(?i)^【\s*(?:day\s*\d+|第\d+部)\s*】\s*", ""), (r"^【\s*(?:福岡|東京|大阪|名古屋|札幌|横浜)\s*[・:：]\s*([^】]+)】$", "$1"), (ROLE_LABELS, " / "), (ROLE_PREFIXES, " / "), (r"(?i)\s+(?:guest|ゲスト)\s+", " / "), (r"(?i)member\s*[:：]\s*", " / "),
    (r"(?i)\s+(?:w/|with\s+guest)\s+", " / "), (r"\s+(?:他|ほか)\s*$", ""), (r"\s*[※＊]\s*ゲストあり\s*$", ""), (r"\s*[（(]\s*順不同\s*[）)]\s*$", ""), (r"(?i)^[\s\-–—]*(?:day\s*\d+|第\d+部)[\s\-–—:：]*", ""),
)
#: What is removed from each name, in this order.
NAME_RULES = (
    r"^[▷▶◆■●+]\s*", r"^[＜<]?(?:司会|出演)[＞>]?\s*", r"^【[^】]+】\s*", r"^[（(]\s*", r"[）)]\s*$", r"(?i)\s*[（(](?:guitar|vocal|bass|keyboards?|drums?|chorus|gt|ba|perc|tp|sax|mc|sousaphone|バンド)[^）)]*[）)]\s*$",
    r"(?i)^[^:：]{0,16}(?:演奏|member|dancer|vj|laser|costume provider)\s*[:：].*$", r"(?i)^MC\s*[:：]\s*", r"\s*→\s*出演キャンセル.*$", r"\s*[※＊]\s*出演者.*$", r"\s+w$",
)
#: Names of places that stand in line-ups without playing.
PLACES = r"(?i)^(?:Zepp\s|新宿(?:LOFT|MARZ|Marble|SAMURAI|Zirco|HEIST|Motion|ACB)|BAR THE LOFT|ROCK CAFE LOFT|HOLIDAY SHINJUKU|club SCIENCE)"
#: Entities that visible text replaces by a space.
ENTITIES = r"(?i)&(?:nbsp|amp|lt|gt|quot|#39);"

#: Katakana from small a to small ke, and the hiragana 0x60 below each.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)


def clean_text(c: Column) -> Column:
    """No-break spaces as spaces, zero-width characters dropped, white space collapsed, ends trimmed. Null: empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u200b-\u200d\u2060\ufeff]", "")
    return F.trim(F.regexp_replace(c, r"(?U)[\s\u00a0]+", " "))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_name(c: Column, compatible: bool = True) -> Column:
    """A name for comparison: cleaned, NFKC (unless the caller knows it changes nothing), lower case, no punctuation."""
    c = clean_text(c)
    return F.regexp_replace(F.lower(nfkc(c) if compatible else c), "(?U)" + NAME_PUNCTUATION, "")


def fold_kana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def fold_japanese(c: Column, compatible: bool = True) -> Column:
    """A name with katakana as hiragana and without long-vowel marks."""
    return F.regexp_replace(fold_kana(normalize_name(c, compatible)), "[ーｰ]", "")


def search_key(c: Column) -> Column:
    return fold_kana(F.lower(F.trim(F.coalesce(c, F.lit("")))))


def split_names(c: Column) -> Column:
    """The distinct names of a line-up, in order; empty for a cancelled single name."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u2009\u200a\u202f]+", " / ")
    raw = F.when(F.regexp_count(raw, F.lit("・")) >= 3, F.replace(raw, F.lit("・"), F.lit(" / "))).otherwise(raw)
    text = clean_text(raw)
    gone = text.rlike("出演キャンセル") & ~text.rlike("[/／、,，×]")
    for pattern, by in LINE_UP_RULES:
        text = F.regexp_replace(text, pattern, by)

    def tidy(x: Column) -> Column:
        x = clean_text(x)
        for pattern in NAME_RULES:
            x = F.regexp_replace(x, pattern, "")
        return x

    names = F.filter(F.transform(F.split(text, NAME_SEPARATORS), tidy), lambda x: (x != "") & ~x.rlike(NOT_NAMES) & ~x.rlike(PLACES))
    return F.when(gone | (text == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(names))


def yen_prices(c: Column) -> Column:
    """All yen amounts, distinct, rising."""
    found = F.regexp_extract_all(clean_text(c), F.lit(r"[¥￥]\s*([\d,]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda x: x.isNotNull())))


#: How price texts write tax, types of tickets with their prices, what is no part of a type's name, and fees for drinks.
TAXED, UNTAXED = r"(?iu)税込|tax\s*included", r"(?iu)税別|税抜|tax\s*excluded"
BRACKET_TYPE, SLASH_TYPE = r"\[([^\]\n]+)\]\s*[¥￥]\s*([\d,]+)", r"(?:^|[\]\s])([^¥￥\n]+?)\s*[/／:：]\s*[¥￥]\s*([\d,]+)"
TYPE_NAME_RULES = (r"(?iu)^.*(?:\[PRICE\]|PRICE)\s*", r"(?iu)^(?:PRICE|料金|チケット)\s*", r"^[\[\]\s]+|[\[\]\s]+$")
DRINK_PRICE, DRINK_DUE = r"(?iu)(?:別途\s*)?(?:ドリンク|drink)(?:代|料金|fee)?[^¥￥\d]{0,12}[¥￥]?\s*([\d,]+)", r"(?iu)(?:別途\s*)?(?:ドリンク|drink)(?:代|料金|fee)?[^。、]{0,12}(?:必要|別)"
DRINK_LABEL = "ドリンク代"


def tax_included(c: Column) -> Column:
    """Whether a price text says that tax is within its prices; null if it says nothing."""
    return F.when(c.rlike(TAXED), True).when(c.rlike(UNTAXED), False)


def yen(digits: Column) -> Column:
    """The number that digits and commas write; commas alone are 0."""
    plain = F.regexp_replace(digits, ",", "")
    return F.when((plain == "") & (digits != ""), F.lit(0).cast("long")).otherwise(plain.try_cast("long"))


def ticket_types(c: Column) -> Column:
    """(name, price_jpy): those with a name in brackets before the price, then others with a name before a slash or colon, each
    once. If there are none: the first price, without a name."""
    text = clean_text(c)

    def found(pattern: str, rules: tuple[str, ...]) -> Column:
        def tidy(name: Column) -> Column:
            for rule in rules:
                name = F.regexp_replace(name, rule, "")
            return F.trim(name)

        names, prices = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        rows = F.transform(F.arrays_zip(names.alias("n"), prices.alias("p")), lambda x: F.struct(tidy(x["n"]).alias("name"), yen(x["p"]).alias("price_jpy")))
        return F.filter(rows, lambda x: (x["name"] != "") & x["price_jpy"].isNotNull())

    bracket = found(BRACKET_TYPE, ())
    named = F.concat(bracket, F.array_except(found(SLASH_TYPE, TYPE_NAME_RULES), bracket))
    first = yen(F.regexp_extract(text, r"[¥￥]\s*([\d,]+)", 1))
    single = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(F.lit(None).cast("string").alias("name"), first.alias("price_jpy")))))
    return F.when(F.size(named) > 0, named).otherwise(single)


def drink_fee(c: Column) -> Column:
    return yen(F.regexp_extract(clean_text(c), DRINK_PRICE, 1))


def additional_fees(c: Column) -> Column:
    """(type, label, amount_jpy, required): the fee for a drink, without an amount where the text states none."""
    text = clean_text(c)
    fee = F.struct(F.lit("drink").alias("type"), F.lit(DRINK_LABEL).alias("label"), drink_fee(c).alias("amount_jpy"), F.lit(True).alias("required"))
    return F.array_compact(F.array(F.when(text.rlike(DRINK_PRICE) | text.rlike(DRINK_DUE), fee)))


def visible_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags; some entities as spaces; white space collapsed."""
    c = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<[^>]+>", ENTITIES):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters; a single character stands for itself."""
    n = F.char_length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Of normalised titles: 1 if equal, 0 if either is empty, else the Jaccard index of their bigrams."""
    return similarity_of(a, b, bigrams(a), bigrams(b))


def similarity_of(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """As title_similarity, from bigrams made once a row, before a join."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(grams_a, grams_b))


def overlap_score(a: Column, b: Column) -> Column:
    """Of normalised names: 1 if equal, the ratio of lengths if one holds the other, else shared characters over the larger set."""
    one, two = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    ratio = F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b))
    shared = F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two), F.lit(1))
    return F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), ratio).otherwise(shared)


#: Patterns of data that must not enter notes: credentials, numbers of documents, of phones, of persons, of cards.
SENSITIVE = (
    r"(?iu)(?:密码|password|passcode|验证码|verification\s*code|one[- ]?time\s*password|otp|cvv)\s*[:：=]?\s*\S{4,}", r"(?iu)(?:护照号|passport\s*(?:no|number)|身份证号|identity\s*(?:no|number)|银行卡号|card\s*(?:no|number))\s*[:：=]?\s*[A-Z0-9][A-Z0-9\s-]{5,}",
    r"(?:^|\D)(?:\+?\d[\s-]?){10,15}(?:\D|$)", r"(?:^|\D)\d{17}[\dXx](?:\D|$)", r"(?:^|\D)(?:\d[ -]?){13,19}(?:\D|$)",
)


def has_sensitive(c: Column, patterns: tuple[str, ...] = SENSITIVE) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c, F.lit("")).rlike(p)
    return out


#: Dates in full, and as month and day.
FULL_DATE, SHORT_DATE = r"(20\d{2})[/.年-](\d{1,2})[/.月-](\d{1,2})日?", r"(?:^|\D)(\d{1,2})[/.月](\d{1,2})日?"


def date_signals(c: Column) -> Column:
    """The distinct dates that a text names: those in full as yyyy-MM-dd, then those of month and day as MM-dd."""

    def two(x: Column) -> Column:
        return F.lpad(x, 2, "0")

    def found(pattern: str, n: int) -> Column:
        groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)]
        return F.transform(F.arrays_zip(*groups), lambda x: F.concat_ws("-", *[x["g1"] if n == 3 and i == 1 else two(x[f"g{i}"]) for i in range(1, n + 1)]))

    return F.array_union(found(FULL_DATE, 3), found(SHORT_DATE, 2))


#: Rules of admission that a text may state, each with what it applies to.
ELIGIBILITY = (
    (r"未就学児(?:童)?入場不可", "未就学児童入場不可", "入場条件"), (r"小学生以上有料", "小学生以上有料", "入場条件"), (r"3歳以上有料", "3歳以上有料", "入場条件"), (r"FC最速先行[^。]{0,40}(?:当選|会員)", "FC最速先行の当選・入金者", "アップグレード受付"),
    (r"小学生以上(?:は)?チケット(?:が)?必要", "小学生以上はチケット必要", "入場条件"), (r"未就学児(?:童)?(?:のお子様)?は大人1名につき1名まで膝上(?:に限り)?無料", "未就学児は大人1名につき1名まで膝上無料", "入場条件"),
    (r"中学生以下のお子様が必ず1名以上[^。]{0,80}満18歳以上の大人が必ず1名以上同席", "中学生以下1名以上と18歳以上の大人1名以上の同席が必要", "ファミリー席"),
)


def eligibility(c: Column) -> Column:
    """(label, applies_to) of each rule that a text states, in the order of the table."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.struct(F.lit(label).alias("label"), F.lit(to).alias("applies_to"))) for p, label, to in ELIGIBILITY]))


#: Phrases of pages behind a wall.
WALLS = (
    r"(?iu)access denied|request blocked|bot verification|human verification|just a moment|アクセスが拒否|アクセスが制限|閲覧制限|人間であることを確認", r"(?iu)ログインしてください|ログインが必要|sign in to continue|login required",
    r"(?iu)i am not a robot|私はロボットではありません|captcha ?を入力",
)
PASSWORD_FIELD, LOGIN_WORD, LOGIN_PATH = r"(?i)<input\b[^>]*\btype=[\"']password[\"']", r"(?iu)login|sign[ -]?in|ログイン|会員", r"(?i)/(?:login|signin|sign-in|auth)(?:[/?#]|$)"

#: Characters that are dropped, and regional ends of venue names, before a page is searched for a venue or date.
PAGE_PUNCTUATION, VENUE_REGION = r"(?U)[\s・･\-_/()（）「」『』：:,.。]", r"(?i)[（(](?:TOKYO|OSAKA|東京都|大阪府)[）)]"


def page_key(c: Column, compatible: bool = True) -> Column:
    """A text for search in pages: NFKC (unless the caller knows that it changes nothing), lower case, without punctuation."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(c) if compatible else c), PAGE_PUNCTUATION, "")


def has_date(key: Column, date: Column) -> Column:
    """Whether a page (its key) names a date, yyyy-M-d: with padded month and day, or without."""
    y, m, d = (F.regexp_extract(date, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i) for i in (1, 2, 3))
    short = F.concat(y, m.try_cast("int").cast("string"), d.try_cast("int").cast("string"))
    return F.coalesce((y != "") & (F.contains(key, F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))) | F.contains(key, short)), F.lit(False))


def has_venue(key: Column, venue: Column, compatible: bool = True) -> Column:
    """Whether a page (its key, made without VENUE_REGION) names a venue. No venue: no."""
    wanted = page_key(F.regexp_replace(F.coalesce(venue, F.lit("")), VENUE_REGION, ""), compatible)
    return (wanted != "") & F.contains(key, wanted)


def has_time(key: Column, time: Column) -> Column:
    """Whether a page (its key) names a time. No time: yes."""
    wanted = page_key(time, False)
    return (wanted == "") | F.contains(key, wanted)
