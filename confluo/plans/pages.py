"""Queries over what pages and texts say: walls, links, dates, line-ups, rules, sales. Each SQL is written from the rules
themselves. Where the tables hold no such texts, both sides add the same ones to every row, by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import clock, sales, text, urls
from confluo.plans.catalogue import query, table
from confluo.sources import records

SECRETS = "CASE doc_id % 9 WHEN 0 THEN ' otp: 123456' WHEN 1 THEN ' cvv 12345' WHEN 2 THEN ' passport no: AB123456' WHEN 3 THEN ' one-time password hidden7' WHEN 4 THEN ' 12345678901234567X ' WHEN 5 THEN ' identity number AB 1234 567' ELSE '' END"


@query(rf"""WITH t AS (SELECT doc_id, text || {SECRETS} AS t FROM documents) SELECT doc_id FROM t WHERE regexp_matches(t, '(?i)(?:密码|password|passcode|验证码|verification\s*code|one[- ]?time\s*password|otp|cvv)\s*[:：=]?\s*\S{{4,}}')
OR regexp_matches(t, '(?i)(?:护照号|passport\s*(?:no|number)|身份证号|identity\s*(?:no|number)|银行卡号|card\s*(?:no|number))\s*[:：=]?\s*[A-Z0-9][A-Z0-9\s-]{{5,}}') OR regexp_matches(t, '(?:^|\D)(?:\+?\d[\s-]?){{10,15}}(?:\D|$)')
OR regexp_matches(t, '(?:^|\D)\d{{17}}[\dXx](?:\D|$)') OR regexp_matches(t, '(?:^|\D)(?:\d[ -]?){{13,19}}(?:\D|$)')""")
def sensitive_text(spark, d):
    return table(spark, d, "documents").filter(text.has_sensitive(F.concat(F.col("text"), F.expr(SECRETS)))).select("doc_id")


SHARED = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://www.xiaohongshu.com/explore/' || page_id || '/?si=1&b=2&a=1' WHEN 2 THEN 'https://X.com/u/status/' || page_id || '?auth_token=t&utm_any=1&q=z#x'
WHEN 3 THEN 'https://me:pw@instagram.com/p/' || page_id WHEN 4 THEN 'https://xhslink.com/' || page_id || '?SESSIONID=9&source=k&code=7&Access_Token=3' ELSE 'ftp://x.com/' || page_id END"""


@query(rf"""WITH s AS (SELECT page_id, {SHARED} AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^(https?)://', 1)) AS scheme, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM s),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','igshid','si','ref','source','access_token','auth_token','session','sessionid','password'], lower(split_part(x, '=', 1))))) AS kept, regexp_replace(host, '^www\.', '') AS h FROM p)
SELECT page_id, CASE WHEN host <> '' AND NOT contains(host, '@') THEN scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url,
CASE WHEN h = 'xhslink.com' OR ends_with(h, 'xiaohongshu.com') THEN 'xhs' WHEN h = 'x.com' OR ends_with(h, 'twitter.com') THEN 'x' WHEN ends_with(h, 'instagram.com') THEN 'instagram' ELSE 'other' END AS platform FROM k""")
def canonical_social_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(SHARED).alias("u"))
    return rows.select("page_id", urls.canonical_social(F.col("u")).alias("canonical_url"), urls.social_platform(F.col("u")).alias("platform"))


OFFICIAL = "CASE page_id % 7 WHEN 0 THEN 'https://eplus.jp/sf/detail/' || page_id WHEN 1 THEN 'https://sub.zaiko.io/e/' || page_id WHEN 2 THEN 'https://eplus.jp/' WHEN 3 THEN 'https://l-tike.com/help/' || page_id WHEN 4 THEN 'https://noteplus.jp/' || page_id ELSE url END"
LABEL = "CASE page_id % 5 WHEN 0 THEN '主催：' || page_id WHEN 1 THEN 'Web サイト' WHEN 2 THEN 'お問い合わせ' WHEN 3 THEN 'ARTIST page' END"


@query(rf"""WITH l AS (SELECT page_id, {OFFICIAL} AS u, coalesce({LABEL}, '') AS label FROM pages), p AS (SELECT *, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) AS host, rtrim(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/') AS path FROM l),
s AS (SELECT *, regexp_matches('.' || host, '\.(?:eplus\.jp|ticket\.pia\.jp|t\.pia\.jp|l-tike\.com|ticket\.tickebo\.jp|ticketbook\.jp|ticket\.rakuten\.co\.jp|ticketpay\.jp|livepocket\.jp|zaiko\.io|cnplayguide\.com)$') AND path <> '' AND NOT regexp_matches(path, '(?i)^/(?:contact|help|guide|faq|login)(?:/|$)') AS sells FROM p)
SELECT page_id, CASE WHEN sells THEN 'ticket_detail' WHEN regexp_matches(label, '主催|問い合わせ|連絡先') THEN 'promoter_official' WHEN regexp_matches(label, '(?i)web\s*サイト|公式|artist') THEN 'artist_official' END AS role FROM s""")
def link_roles(spark, d):
    return table(spark, d, "pages").select("page_id", urls.link_role(F.expr(OFFICIAL), F.expr(LABEL)).alias("role"))


WALLED = """html || CASE page_id % 12 WHEN 0 THEN '<p>Access  <b>Denied</b></p>' WHEN 1 THEN '<p>アクセスが制限されています</p>' WHEN 2 THEN '<form>ログイン<input name="p" type="password"></form>' WHEN 3 THEN '<form>Anmelden<input type="password"></form>' WHEN 4 THEN '<p>Login required</p>' WHEN 5 THEN '<script>var captcha = "I am not a robot"</script>' WHEN 6 THEN '<p>CAPTCHA を入力</p>' ELSE '' END"""
LANDED = "CASE page_id % 11 WHEN 0 THEN 'https://x.example/a/Sign-In?next=' || page_id WHEN 1 THEN 'https://x.example/authors/' || page_id ELSE url END"


@query(r"""WITH p AS (SELECT page_id, HTML AS html, LANDED AS u FROM pages), v AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '(?i)&(nbsp|amp|lt|gt|quot|#39);', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM p)
SELECT page_id, regexp_matches(t, '(?i)access denied|request blocked|bot verification|human verification|just a moment|アクセスが拒否|アクセスが制限|閲覧制限|人間であることを確認') OR regexp_matches(t, '(?i)ログインしてください|ログインが必要|sign in to continue|login required') OR regexp_matches(t, '(?i)i am not a robot|私はロボットではありません|captcha ?を入力')
OR (regexp_matches(html, '(?i)<input\b[^>]*\btype=["'']password["'']') AND regexp_matches(t, '(?i)login|sign[ -]?in|ログイン|会員')) OR regexp_matches(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '(?i)/(?:login|signin|sign-in|auth)(?:[/?#]|$)') AS walled FROM v""".replace("HTML", WALLED).replace("LANDED", LANDED))
def access_walls(spark, d):
    return table(spark, d, "pages").select("page_id", records.access_restricted(F.expr(WALLED), F.expr(LANDED)).alias("walled"))


DATED = "text || ' 2026年7月' || (doc_id % 28 + 1) || '日、' || (doc_id % 12 + 1) || '/' || (doc_id % 31 + 1) || ' and 2027-' || (doc_id % 9 + 1) || '-04 or 3.' || (doc_id % 10)"


@query(rf"""WITH t AS (SELECT doc_id, {DATED} AS t FROM documents), f AS (SELECT doc_id, regexp_extract_all(t, '20\d{{2}}[/.年-]\d{{1,2}}[/.月-]\d{{1,2}}日?') AS a, regexp_extract_all(t, '(?:^|\D)\d{{1,2}}[/.月]\d{{1,2}}日?') AS b FROM t WHERE t IS NOT NULL),
v AS (SELECT doc_id, list_concat(list_transform(a, lambda x: regexp_extract(x, '\d+') || '-' || lpad(regexp_extract(x, '\d+\D(\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(x, '\d+\D\d+\D(\d+)', 1), 2, '0')), list_transform(b, lambda x: lpad(regexp_extract(x, '\d+'), 2, '0') || '-' || lpad(regexp_extract(x, '\d+\D(\d+)', 1), 2, '0'))) AS d FROM f)
SELECT doc_id, array_to_string(list_sort(list_distinct(d)), ',') AS dates FROM v""")
def text_dates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(DATED).alias("t")).filter("t is not null")
    return rows.select("doc_id", F.array_join(F.array_sort(text.date_signals(F.col("t"))), ",").alias("dates"))


LINE_UP = """CASE p_partkey % 14 WHEN 0 THEN '出演：' || p_name || ' / ' || p_brand WHEN 1 THEN '【DAY 2】' || p_name || '、' || p_brand || ' 他' WHEN 2 THEN '【大阪・' || p_name || ' × ' || p_brand || '】' WHEN 3 THEN p_name || ' 【GUEST】' || p_brand || ' with guest ' || p_type WHEN 4 THEN p_name || '（guitar）, MC：' || p_brand
WHEN 5 THEN 'Zepp ' || p_name || ' / ' || p_brand || ' w' WHEN 6 THEN p_name || ' →出演キャンセルとなりました' WHEN 7 THEN p_name || '・' || p_brand || '・' || p_type || '・one' WHEN 8 THEN 'DAY1 - ' || p_name || ' and ' || p_brand || ' & ' || p_name WHEN 9 THEN p_name || ' ※ゲストあり' WHEN 10 THEN '■ゲスト：' || p_name || ' member：' || p_brand
WHEN 11 THEN p_name || ' / dancer：' || p_brand || ' / more... / (' || p_type || ')' WHEN 12 THEN 'WHITE SCORPION ' || p_name ELSE '出演者：ハロプロ研修生北海道 / ' || p_name || ' (順不同)' END"""


def replaced(c: str, rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL that replaces all matches of each pattern in turn."""
    for pattern, by in rules:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


LINE_UP_SQL = [
    (r"^出演者?\s*[:：]\s*ハロプロ研修生(\p{Han})", r"ハロプロ研修生 / \1"), (r"^出演者?\s*[:：]\s*", ""), (r"ハロプロ研修生(\p{Han})", r"ハロプロ研修生 / \1"), (r"^(WHITE SCORPION)\s+(.+)$", r"\1 / \2"), (r"(?i)^【\s*(?:day\s*\d+|第\d+部)\s*】\s*", ""), (r"^【\s*(?:福岡|東京|大阪|名古屋|札幌|横浜)\s*[・:：]\s*([^】]+)】$", r"\1"),
    (r"(?i)[【［<＜](?:guest|ゲスト|出演|opening\s*act|live\s*act)[】］>＞]", " / "), (r"(?i)[■◆●・]?\s*(?:スペシャルゲスト|guest|ゲスト|opening\s*act|live\s*act|出演|vs)\s*[:：]\s*", " / "), (r"(?i)\s+(?:guest|ゲスト)\s+", " / "), (r"(?i)member\s*[:：]\s*", " / "), (r"(?i)\s+(?:w/|with\s+guest)\s+", " / "),
    (r"\s+(?:他|ほか)\s*$", ""), (r"\s*[※＊]\s*ゲストあり\s*$", ""), (r"\s*[（(]\s*順不同\s*[）)]\s*$", ""), (r"(?i)^[\s\-–—]*(?:day\s*\d+|第\d+部)[\s\-–—:：]*", ""),
]
NAME_SQL = [
    (r"\s+", " "), (r"^ | $", ""), (r"^[▷▶◆■●+]\s*", ""), (r"^[＜<]?(?:司会|出演)[＞>]?\s*", ""), (r"^【[^】]+】\s*", ""), (r"^[（(]\s*", ""), (r"[）)]\s*$", ""), (r"(?i)\s*[（(](?:guitar|vocal|bass|keyboards?|drums?|chorus|gt|ba|perc|tp|sax|mc|sousaphone|バンド)[^）)]*[）)]\s*$", ""),
    (r"(?i)^[^:：]{0,16}(?:演奏|member|dancer|vj|laser|costume provider)\s*[:：].*$", ""), (r"(?i)^MC\s*[:：]\s*", ""), (r"\s*→\s*出演キャンセル.*$", ""), (r"\s*[※＊]\s*出演者.*$", ""), (r"\s+w$", ""),
]


@query(rf"""WITH r AS (SELECT p_partkey, {LINE_UP} AS raw FROM part), m AS (SELECT p_partkey, trim(regexp_replace(CASE WHEN len(regexp_extract_all(raw, '・')) >= 3 THEN replace(raw, '・', ' / ') ELSE raw END, '\s+', ' ', 'g')) AS t FROM r),
s AS (SELECT p_partkey, contains(t, '出演キャンセル') AND NOT regexp_matches(t, '[/／、,，×]') AS gone, regexp_split_to_array({replaced("t", LINE_UP_SQL)}, '(?i)\s*(?:/|／|、|,|，|×|\s&\s|\band\b|\bx\b)\s*') AS parts FROM m),
n AS (SELECT p_partkey, CASE WHEN gone THEN [] ELSE list_filter(list_transform(parts, lambda x: {replaced("x", NAME_SQL)}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:guest|ゲスト|出演者|more(?:\.{{3}}|…)?|coming\s*soon(?:…|\.\.\.)?|not\s*found)$') AND NOT regexp_matches(x, '(?i)^(?:Zepp\s|新宿(?:LOFT|MARZ|Marble|SAMURAI|Zirco|HEIST|Motion|ACB)|BAR THE LOFT|ROCK CAFE LOFT|HOLIDAY SHINJUKU|club SCIENCE)')) END AS names FROM s)
SELECT p_partkey, array_to_string(list_sort(list_distinct(names)), '|') AS names FROM n""")
def line_up_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.split_names(F.expr(LINE_UP))), "|").alias("names"))


ADMISSION = """text || CASE doc_id % 10 WHEN 0 THEN ' 未就学児入場不可。' WHEN 1 THEN ' 小学生以上有料、3歳以上有料。' WHEN 2 THEN ' FC最速先行にて当選された方' WHEN 3 THEN ' FC最速先行。当選' WHEN 4 THEN ' 小学生以上はチケットが必要' WHEN 5 THEN ' 未就学児童のお子様は大人1名につき1名まで膝上に限り無料'
WHEN 6 THEN ' 中学生以下のお子様が必ず1名以上、満18歳以上の大人が必ず1名以上同席' ELSE '' END"""


@query(f"""WITH r(n, pattern, rule) AS (VALUES (1, '未就学児(?:童)?入場不可', '未就学児童入場不可:入場条件'), (2, '小学生以上有料', '小学生以上有料:入場条件'), (3, '3歳以上有料', '3歳以上有料:入場条件'), (4, 'FC最速先行[^。]{{0,40}}(?:当選|会員)', 'FC最速先行の当選・入金者:アップグレード受付'), (5, '小学生以上(?:は)?チケット(?:が)?必要', '小学生以上はチケット必要:入場条件'),
(6, '未就学児(?:童)?(?:のお子様)?は大人1名につき1名まで膝上(?:に限り)?無料', '未就学児は大人1名につき1名まで膝上無料:入場条件'), (7, '中学生以下のお子様が必ず1名以上[^。]{{0,80}}満18歳以上の大人が必ず1名以上同席', '中学生以下1名以上と18歳以上の大人1名以上の同席が必要:ファミリー席')), t AS (SELECT doc_id, {ADMISSION} AS t FROM documents)
SELECT doc_id, string_agg(rule, '|' ORDER BY n) AS rules FROM t JOIN r ON regexp_matches(t, pattern) GROUP BY doc_id""")
def eligibility_rules(spark, d):
    """The rules of admission that a text states, with what they apply to; all rules in one pass over the texts."""
    rules = F.transform(text.eligibility(F.expr(ADMISSION)), lambda x: F.concat_ws(":", x["label"], x["applies_to"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(rules, "|").alias("rules")).filter("rules <> ''")


SHOWN = "text || CASE doc_id % 5 WHEN 0 THEN ' 2026/07/' || lpad(doc_id % 28 + 1, 2, '0') || ' (日) 19:00 ' WHEN 1 THEN ' 2026.7.' || (doc_id % 28 + 1) || ' 開演 19：00 ' WHEN 2 THEN ' 2026年7月1日' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN 'ＺＥＰＰ Shinjuku' WHEN 1 THEN 'Zepp Shinjuku(TOKYO)' ELSE '' END"


@query(rf"""WITH t AS (SELECT doc_id, ({SHOWN.replace("lpad(doc_id % 28 + 1, 2, '0')", "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')")}) AS t FROM documents), k AS (SELECT doc_id, regexp_replace(lower(replace(replace(t, 'ＺＥＰＰ', 'ZEPP'), '：', ':')), '[\s・･\-_/()（）「」『』：:,.。]', '', 'g') AS k FROM t WHERE t IS NOT NULL)
SELECT doc_id, contains(k, '202607' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) OR contains(k, '20267' || (doc_id % 28 + 1)) AS has_date, contains(k, 'zeppshinjuku') AS has_venue, contains(k, '1900') AS has_time FROM k""")
def context_in_text(spark, d):
    """Whether a text names a date (in either form), a venue (whatever its width or region) and a time."""
    rows = table(spark, d, "documents").select("doc_id", text.page_key(F.expr(SHOWN)).alias("k"), F.expr(SHOWN).alias("t")).filter("t is not null")
    date = F.concat(F.lit("2026-7-"), F.col("doc_id") % 28 + 1)
    return rows.select("doc_id", text.has_date(F.col("k"), date).alias("has_date"), text.has_venue(F.col("k"), F.lit("Zepp Shinjuku（TOKYO）")).alias("has_venue"), text.has_time(F.col("k"), F.lit("19:00")).alias("has_time"))


LINKS = """CASE page_id % 13 WHEN 0 THEN 'https://eplus.jp/sf/detail/' || page_id WHEN 1 THEN 'https://eplus.jp/sf/word/' || page_id WHEN 2 THEN 'https://t.pia.jp/pia/event/event.do?eventCd=' || page_id WHEN 3 THEN 'https://l-tike.com/mevent/?mid=' || page_id WHEN 4 THEN 'https://l-tike.com/search/?keyword=x' WHEN 5 THEN 'https://www.ticketbook.jp/event/1?info=' || page_id
WHEN 6 THEN 'https://x.jp/help/' WHEN 7 THEN 'https://x.jp/refund2.html' WHEN 8 THEN 'https://livepocket.jp/e/' || page_id WHEN 9 THEN 'https://tiget.net/events/' || page_id WHEN 10 THEN 'no link' ELSE url END"""


@query(rf"""WITH l AS (SELECT {LINKS} AS u FROM pages), p AS (SELECT u, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS q FROM l),
w AS (SELECT *, CASE WHEN regexp_matches(host, '(?:^|\.)eplus\.jp$') THEN 'eplus' WHEN regexp_matches(host, '(?:^|\.)pia\.jp$') THEN 'pia' WHEN regexp_matches(host, '(?:^|\.)l-tike\.com$') THEN 'lawson' WHEN regexp_matches(host, '(?:^|\.)ticketbook\.jp$') THEN 'ticketbook' ELSE 'other' END AS provider, lower(rtrim(path, '/')) || lower(q) AS place, rtrim(path, '/') AS short FROM p)
SELECT CASE WHEN host = '' THEN 'unknown' WHEN regexp_matches(place, '(?:^|[/_-])refund\d*(?:[/_.-]|$)|haraimodoshi|払い?戻し?') THEN 'refund' WHEN regexp_matches(place, '(?:^|[/_-])(?:help|faq|support|guide|contact)(?:[/_.-]|$)|/hc/') THEN 'support' WHEN regexp_matches(place, '/search(?:[_/-]|/)|[?&](?:kw|keyword|q)=|search_all\.do') THEN 'search'
WHEN (provider = 'eplus' AND contains(path, '/sf/detail/')) OR (provider = 'pia' AND contains(path, '/event/event.do') AND regexp_matches(q, '(?i)[?&](?:eventCd|eventBundleCd)=')) OR (provider = 'lawson' AND regexp_matches(short, '/mevent(?:/|$)') AND regexp_matches(q, '(?i)[?&]mid=')) OR (provider = 'ticketbook' AND regexp_matches(path, '/(?:event|detail|ticket)/')) OR regexp_matches(host || path, 'livepocket\.jp/(?:e|ticket)|tiget\.net/events|t-dv\.com/') THEN 'event_detail'
WHEN provider <> 'other' THEN 'generic_provider' ELSE 'unknown' END AS kind, provider, count(*) AS n FROM w GROUP BY 1, 2""")
def url_kinds(spark, d):
    return table(spark, d, "pages").select(F.expr(LINKS).alias("u")).groupBy(urls.kind(F.col("u")).alias("kind"), urls.provider(F.col("u")).alias("provider")).agg(F.count("*").alias("n"))


HEADERS = """CASE event_type WHEN 'error' THEN '' || CAST(floor(value) AS BIGINT) WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Tue, 16 Jan 2024 00:00:' || (event_id % 50 + 10) || ' GMT' WHEN 1 THEN 'Sat, 6 Jan 2024 10:00:00 GMT' ELSE 'soon' END WHEN 'click' THEN '' END"""


@query(rf"""WITH h AS (SELECT event_id, user_id % 8 AS attempt, {HEADERS} AS v, (event_id % 5) / 4.0 AS r FROM events), a AS (SELECT *, TRY_CAST(v AS DOUBLE) AS s, regexp_extract(v, '(\d{{1,2}} [A-Za-z]{{3}} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}})', 1) AS day FROM h),
m AS (SELECT *, CASE WHEN s >= 0 THEN CAST(round(s * 1000) AS BIGINT) WHEN s IS NULL AND day <> '' THEN greatest(0, epoch_ms(strptime(CASE WHEN day = '' THEN NULL ELSE day END, '%-d %b %Y %H:%M:%S')) - epoch_ms(TIMESTAMP '2024-01-16')) END AS asked FROM a)
SELECT CAST(CASE WHEN asked >= 0 THEN least(asked, 60000) ELSE floor(least(30000.0::DOUBLE, 500.0::DOUBLE * pow(2, greatest(0, attempt - 1))) * (0.75::DOUBLE + CAST(r AS DOUBLE) * 0.5::DOUBLE) + 0.5) END AS BIGINT) AS wait_ms, count(*) AS n FROM m GROUP BY 1""")
def retry_policy(spark, d):
    asked = clock.retry_after_ms(F.expr(HEADERS), F.lit("2024-01-16 00:00:00").cast("timestamp"))
    wait = clock.retry_delay_ms(F.col("user_id") % 8, asked, (F.col("event_id") % 5) / 4.0)
    return table(spark, d, "events").groupBy(wait.alias("wait_ms")).agg(F.count("*").alias("n"))


SOLD = """' ' || CASE page_id % 9 WHEN 0 THEN '先着★一般発売 受付期間：2026年7月' || (page_id % 28 + 1) || '日(土) 10:00 〜 2026/8/3 23:59 受付中 残りわずか' WHEN 1 THEN 'FC会員先行 申込期間 2026.6.1 12:00～2026.6.9 結果発表 2026/6/12 18:00 入金期限 2026/6/15 受付終了' WHEN 2 THEN '抽選 エントリー期間 2026/9/1 - 2026/9/5 販売開始前'
WHEN 3 THEN '販売期間 2026/1/1 0:00~2026/12/31 予定枚数終了 公式リセール' WHEN 4 THEN '受付 2026/3/1〜2026/3/2 在庫あり 申込には無料の会員登録が必要 SMS認証 日本国内の電話番号が必要' WHEN 5 THEN '同行者の方も事前登録 チケットは譲渡不可 本人確認あり AnyPASS チケット表示開始 2026/7/1 9:00' WHEN 6 THEN '受付期間 2026/5/1〜2026/5/2 受付終了 次の受付期間 2026/7/1〜2026/7/20 受付中' ELSE '' END"""
SALE_AT = "2026-07-10 00:00:00"
_M = r"(20\d{2})[/.年](\d{1,2})[/.月](\d{1,2})日?(?:\([^)]*\))?\s*(?:(\d{1,2})[:：](\d{2}))?"
_P = rf"(?:受付|申込|販売|発売|エントリー)(?:期間)?[^0-9]{{0,80}}{_M}\s*(?:[〜～~]|-)\s*{_M}"


def _sql_moment(c: str, pattern: str = _M, first: int = 1) -> str:
    g = [f"regexp_extract({c}, '{pattern}', {first + i})" for i in range(5)]
    return f"CASE WHEN {g[0]} <> '' THEN {g[0]} || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0') || 'T' || lpad(CASE {g[3]} WHEN '' THEN '00' ELSE {g[3]} END, 2, '0') || ':' || CASE {g[4]} WHEN '' THEN '00' ELSE {g[4]} END || '+09:00' END"


def _sql_labelled(labels: str) -> str:
    return _sql_moment(f"regexp_extract(t, '(?:{labels}).{{0,100}}')")


@query(rf"""WITH v AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '(?i)&(nbsp|amp|lt|gt|quot|#39);', ' ', 'g'), '\s+', ' ', 'g')) || {SOLD} AS t FROM pages),
i AS (SELECT *, regexp_extract(t, '{_P}') AS whole, {_sql_moment("t", _P, 1)} AS start_at, {_sql_moment(f"regexp_replace(regexp_extract(t, '{_P}'), '^[^0-9]*{_M}"+r"\s*(?:[〜～~]|-)\s*', '')")} AS end_at FROM v), j AS (SELECT *, instr(t, whole) AS pos, substr(t, instr(t, whole) + len(whole)) AS rest FROM i),
k AS (SELECT *, regexp_extract(rest, '{_P}') AS nxt FROM j), s AS (SELECT *, CASE WHEN whole = '' THEN t ELSE substr(t, greatest(1, pos - 120), pos + len(whole) + CASE WHEN nxt = '' THEN 1200 ELSE instr(rest, nxt) - 1 END - greatest(1, pos - 120)) END AS sale FROM k),
f AS (SELECT *, regexp_matches(sale, '受付中|販売中|発売中') AS o, regexp_matches(sale, '受付開始前|販売開始前|発売開始前') AS e, regexp_matches(sale, '受付終了|販売終了|発売終了') AS c, CAST(start_at AS TIMESTAMPTZ) AS a, CAST(end_at AS TIMESTAMPTZ) AS b, TIMESTAMPTZ '{SALE_AT}+00' AS now FROM s)
SELECT page_id, CASE WHEN regexp_matches(sale, '(?i)ファンクラブ(?:会員)?(?:限定|先行|抽選)|FC会員(?:限定|先行|抽選)') THEN 'fan_club_lottery' WHEN regexp_matches(sale, '公式リセール|定価リセール') THEN 'official_resale' WHEN contains(sale, '抽選') THEN 'playguide_lottery' WHEN regexp_matches(sale, '一般発売|先着') THEN 'general_sale' ELSE 'other' END AS sale_type,
CASE WHEN o AND NOT c THEN 'open' WHEN e AND NOT o AND NOT c THEN 'not_started' WHEN c AND NOT o THEN 'closed' WHEN NOT o AND NOT c AND a > now THEN 'not_started' WHEN NOT o AND NOT c AND a <= now AND (b IS NULL OR b >= now) THEN 'open' WHEN NOT o AND NOT c AND b < now THEN 'closed' ELSE 'unknown' END AS sale_status,
CASE WHEN regexp_matches(sale, '(?i)予定枚数終了|完売|SOLD\s*OUT') THEN 'sold_out' WHEN regexp_matches(sale, '残りわずか|残席わずか') THEN 'low' WHEN contains(sale, '在庫あり') THEN 'available' ELSE 'unknown' END AS inventory_status, start_at, end_at, {_sql_labelled("結果(?:確認|発表)|当落(?:確認|発表)")} AS result_at, {_sql_labelled("入金(?:期間|期限)|支払(?:期間|期限)")} AS payment_deadline,
{_sql_labelled("チケット(?:表示|ダウンロード)(?:開始|予定|可能)|表示開始|ダウンロード開始")} AS ticket_display_at, CASE WHEN regexp_matches(sale, '(?i)ファンクラブ会員限定|FC会員限定') THEN 'ファンクラブ会員限定' WHEN regexp_matches(sale, '(?i)申込(?:み)?には.{{0,40}}(?:会員登録|会員アカウント).{{0,20}}(?:必要|必須)') THEN '申请需要会员账号' END AS membership_requirement,
CASE WHEN regexp_matches(t, '日本国内(?:在住|居住)(?:者)?(?:のみ|限定)') THEN '仅限日本国内居住者' WHEN regexp_matches(t, '日本国内の(?:携帯)?電話番号(?:が必要|必須)') THEN '需要日本国内电话号码' END AS region_restriction, CASE WHEN regexp_matches(t, '(?i)SMS(?:による)?認証') THEN '需要 SMS 认证' WHEN contains(t, '電話番号認証') THEN '需要电话号码认证' END AS phone_verification,
CASE WHEN regexp_matches(t, '同行者.{{0,40}}(?:事前登録|登録が必要|登録必須)') THEN '同行者需要事先登记' WHEN regexp_matches(t, '同行者.{{0,40}}(?:スマートフォン|携帯電話).{{0,20}}(?:必要|必須)') THEN '同行者需要可用手机' WHEN regexp_matches(t, '同行者.{{0,40}}本人確認') THEN '同行者可能需要本人确认' END AS companion_restriction,
CASE WHEN regexp_matches(t, '(?:チケット|電子チケット).{{0,40}}(?:分配不可|分配できません|譲渡不可)') THEN '票券不可分配' WHEN regexp_matches(t, '(?:同行者|チケット).{{0,40}}(?:分配が必要|分配必須)') THEN '需要向同行者分配票券' END AS ticket_distribution, nullif(regexp_extract(t, '(?i)AnyPASS|MOALA|チケプラ|ローチケ電子チケット|ticket\s*board'), '') AS ticket_app,
CASE WHEN regexp_matches(t, '日本国内の(?:携帯)?電話番号') THEN TRUE END AS requires_japanese_phone, CASE WHEN regexp_matches(t, '本人確認(?:が必要|は必須|必須|あり|を実施|を行|の実施)|顔写真(?:付き|つき)?の本人確認') THEN TRUE END AS identity_check FROM f""")
def page_offers(spark, d):
    """What each page says of a sale: period, deadlines, state, stock, type and requirements."""
    rows = table(spark, d, "pages").select("page_id", F.concat(text.visible_text(F.col("html")), F.expr(SOLD)).alias("t"))
    return rows.select("page_id", *[c.alias(k) for k, c in sales.offer(F.col("t"), F.lit(f"{SALE_AT}").cast("timestamp")).items()])
