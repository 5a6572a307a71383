"""Sales as pages state them: periods, deadlines, states and requirements, read from the visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How pages write moments and periods of sale.
MOMENT = r"(20\d{2})[/.年](\d{1,2})[/.月](\d{1,2})日?(?:\([^)]*\))?\s*(?:(\d{1,2})[:：](\d{2}))?"
PERIOD = rf"(?:受付|申込|販売|発売|エントリー)(?:期間)?[^0-9]{{0,80}}{MOMENT}\s*(?:[〜～~]|-)\s*{MOMENT}"
#: Labels of deadlines.
RESULT, PAYMENT, DISPLAY = r"結果(?:確認|発表)|当落(?:確認|発表)", r"入金(?:期間|期限)|支払(?:期間|期限)", r"チケット(?:表示|ダウンロード)(?:開始|予定|可能)|表示開始|ダウンロード開始"
#: Words that tell the state of a sale, its stock and its type.
OPEN, NOT_STARTED, CLOSED = r"受付中|販売中|発売中", r"受付開始前|販売開始前|発売開始前", r"受付終了|販売終了|発売終了"
STOCK = (("sold_out", r"(?i)予定枚数終了|完売|SOLD\s*OUT"), ("low", r"残りわずか|残席わずか"), ("available", r"在庫あり"))
TYPES = (("fan_club_lottery", r"(?i)ファンクラブ(?:会員)?(?:限定|先行|抽選)|FC会員(?:限定|先行|抽選)"), ("official_resale", r"公式リセール|定価リセール"), ("playguide_lottery", r"抽選"), ("general_sale", r"一般発売|先着"))
#: Requirements, the first of each list that a text states; and apps that show tickets.
MEMBERSHIP = ((r"(?i)ファンクラブ会員限定|FC会員限定", "ファンクラブ会員限定"), (r"(?i)申込(?:み)?には.{0,40}(?:会員登録|会員アカウント).{0,20}(?:必要|必須)", "申请需要会员账号"))
REGION = ((r"(?i)日本国内(?:在住|居住)(?:者)?(?:のみ|限定)", "仅限日本国内居住者"), (r"(?i)日本国内の(?:携帯)?電話番号(?:が必要|必須)", "需要日本国内电话号码"))
PHONE = ((r"(?i)SMS(?:による)?認証|SMS認証", "需要 SMS 认证"), (r"(?i)電話番号認証", "需要电话号码认证"))
COMPANION = ((r"(?i)同行者.{0,40}(?:事前登録|登録が必要|登録必須)", "同行者需要事先登记"), (r"(?i)同行者.{0,40}(?:スマートフォン|携帯電話).{0,20}(?:必要|必須)", "同行者需要可用手机"), (r"(?i)同行者.{0,40}本人確認", "同行者可能需要本人确认"))
SHARING = ((r"(?i)(?:チケット|電子チケット).{0,40}(?:分配不可|分配できません|譲渡不可)", "票券不可分配"), (r"(?i)(?:同行者|チケット).{0,40}(?:分配が必要|分配必須)", "需要向同行者分配票券"))
APPS = r"(?i)AnyPASS|MOALA|チケプラ|ローチケ電子チケット|ticket\s*board"


def moment(c: Column, pattern: str = MOMENT, first: int = 1) -> Column:
    """The moment that five groups of a pattern write, in Japanese time; midnight where no time is given. Null if there is none."""
    y, m, d, hour, minute = (F.regexp_extract(c, pattern, first + i) for i in range(5))
    padded = lambda x: F.lpad(F.when(x == "", "00").otherwise(x), 2, "0")
    minutes = F.when(minute == "", "00").otherwise(minute)
    return F.when(y != "", F.concat(y, F.lit("-"), padded(m), F.lit("-"), padded(d), F.lit("T"), padded(hour), F.lit(":"), minutes, F.lit("+09:00")))


def period(c: Column) -> tuple[Column, Column]:
    """The first period of sale: start and end."""
    return moment(c, PERIOD, 1), moment(c, PERIOD, 6)


def labelled(c: Column, labels: str) -> Column:
    """The first moment within 100 characters after a label's first mention."""
    return moment(F.regexp_extract(c, f"(?:{labels}).{{0,100}}", 0))


def first_sale(c: Column, lead: int = 120, most: int = 1200) -> Column:
    """The part of a text about its first period of sale, with the `lead` characters before it, up to the next period or
    `most` characters after. Without a period: the whole text."""
    at, size = F.regexp_instr(c, F.lit(PERIOD)), F.char_length(F.regexp_extract(c, PERIOD, 0))
    following = F.regexp_instr(F.substr(c, at + size), F.lit(PERIOD))
    end = at + size + F.when(following > 0, following - 1).otherwise(most)
    begin = F.greatest(F.lit(1), at - lead)
    return F.when(at == 0, c).otherwise(F.substr(c, begin, end - begin))


def sale_state(sale: Column, start: Column, end: Column, now: Column) -> Column:
    """What the words of a sale say if they agree; without any, what its period says."""
    opened, early, closed = sale.rlike(OPEN), sale.rlike(NOT_STARTED), sale.rlike(CLOSED)
    a, b = (F.try_to_timestamp(F.replace(x, F.lit("+09:00"), F.lit(":00+09:00"))) for x in (start, end))
    silent = ~opened & ~closed
    return (
        F.when(opened & ~closed, "open").when(early & ~opened & ~closed, "not_started").when(closed & ~opened, "closed")
        .when(silent & (a > now), "not_started").when(silent & (a <= now) & (b.isNull() | (b >= now)), "open").when(silent & (b < now), "closed").otherwise("unknown")
    )


def first_match(c: Column, named: tuple[tuple[str, str], ...], other: Column) -> Column:
    """The name of the first pattern that a text meets."""
    out = other
    for name, pattern in reversed(named):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def requirement(c: Column, stated: tuple[tuple[str, str], ...]) -> Column:
    return first_match(c, tuple((label, pattern) for pattern, label in stated), F.lit(None).cast("string"))


def stock_of_schema(c: Column) -> Column:
    """The stock that a page's linked data states."""
    x = F.lower(F.coalesce(c, F.lit("")))
    return F.when(x.contains("soldout"), "sold_out").when(x.contains("limitedavailability"), "low").when(x.contains("instock"), "available").otherwise("unknown")


def offer(page: Column, now: Column) -> dict[str, Column]:
    """What the visible text of a page about one offer says of it."""
    sale = first_sale(page)
    start, end = period(page)
    flag = lambda pattern: F.when(page.rlike(pattern), True)
    return {
        "sale_type": first_match(sale, TYPES, F.lit("other")), "sale_status": sale_state(sale, start, end, now), "inventory_status": first_match(sale, STOCK, F.lit("unknown")), "start_at": start, "end_at": end,
        "result_at": labelled(page, RESULT), "payment_deadline": labelled(page, PAYMENT), "ticket_display_at": labelled(page, DISPLAY), "membership_requirement": requirement(sale, MEMBERSHIP), "region_restriction": requirement(page, REGION),
        "phone_verification": requirement(page, PHONE), "companion_restriction": requirement(page, COMPANION), "ticket_distribution": requirement(page, SHARING), "ticket_app": F.nullif(F.regexp_extract(page, APPS, 0), F.lit("")),
        "requires_japanese_phone": flag(r"日本国内の(?:携帯)?電話番号"), "identity_check": flag(r"本人確認(?:が必要|は必須|必須|あり|を実施|を行|の実施)|顔写真(?:付き|つき)?の本人確認"),
    }
