"""The catalog queries as plain SQL for a second engine, written independently of the DataFrame code.

Text rules are checked the slow way here: texts are split into rows and joined with the word lists.
"""

from __future__ import annotations

from reviewlake.functions.vocabulary import (
    CONTRACTIONS, DEFAULT_LEXICON, DEFAULT_TAXONOMY, HEURISTIC_WORDS,
)
from reviewlake.plans.demo_tables import SEED_PHRASES
from reviewlake.schemas import COMPLIMENTS

WS = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LABELS = ("positive", "neutral", "negative")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {_q(pattern)}, {_q(to)}, 'g')"


def _strip(c: str) -> str:
    return _re(c, f"^[{WS}]+|[{WS}]+$")


def _collapse(c: str) -> str:
    return _re(c, f"[{WS}]+", " ")


def _links(c: str) -> str:
    return _re(_re(f"lower({c})", f"http[^{WS}]+|www[^{WS}]+"), f"[^{WS}]+@[^{WS}]+")


def _clean_basic(c: str) -> str:
    return f"coalesce({_strip(_collapse(_re(_links(c), r'@[\p{L}\p{N}_]+')))}, '')"


def _clean_nlp(c: str) -> str:
    out = _re(_clean_basic(c), f"[^a-zA-Z0-9'{WS}]")
    for short, full in CONTRACTIONS:
        out = f"replace({out}, {_q(short)}, {_q(full)})"
    return _strip(out)


def _clean_letters(c: str, letters: str) -> str:
    return f"coalesce({_strip(_collapse(_re(_links(c), f'[^{letters}{WS}]')))}, '')"


def _clean_ml(c: str) -> str:
    out = _re(_links(c), r"\b\d+\b")
    return f"coalesce({_strip(_collapse(_re(out, f'[^a-zA-Z{WS}\\x{{C0}}-\\x{{17F}}]', ' ')))}, '')"


def _stars_label(c: str) -> str:
    return f"CASE WHEN {c} >= 4 THEN 'positive' WHEN {c} <= 2 THEN 'negative' WHEN {c} = 3 THEN 'neutral' END"


def _cut_label(c: str, cut: str) -> str:
    return f"CASE WHEN {c} >= {cut} THEN 'positive' WHEN {c} <= -{cut} THEN 'negative' WHEN {c} IS NOT NULL THEN 'neutral' END"


def _pct(part: str, whole: str, digits: int) -> str:
    return f"round({part} / nullif({whole}, 0) * 100, {digits})"


def _n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _rows(pairs: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in p) + ")" for p in pairs)


_PHRASE = "CASE (e.event_id * 3 + e.user_id) % 8 " + " ".join(
    f"WHEN {k} THEN {_q(v)}" for k, v in SEED_PHRASES.items()) + " ELSE '' END"
_COMPLIMENTS = ", ".join(f"CAST(c_custkey % {i + 2} AS INT) AS compliment_{n}" for i, n in enumerate(COMPLIMENTS))

# Shared tables, each with the tables it reads.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_reviews": ((), f"""
        SELECT e.event_id AS review_id, e.user_id, e.event_id % p.n AS business_id,
               CAST(1 + (e.event_id * 7 + e.user_id) % 5 AS INT) AS stars,
               CAST(e.event_id % 11 AS INT) AS useful, CAST(e.event_id % 5 AS INT) AS funny,
               CAST(e.event_id % 7 AS INT) AS cool, {_PHRASE} || d.text AS text, e.ts AS ts, d.lang AS language
        FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) dn CROSS JOIN (SELECT count(*) AS n FROM part) p
        JOIN documents d ON d.doc_id = e.event_id % dn.n"""),
    "reviews": (("raw_reviews",), f"""
        SELECT review_id, user_id, business_id, stars, {_strip("text")} AS text, CAST(length(text) AS INT) AS text_length,
               CAST(len(string_split(text, ' ')) AS INT) AS word_count, useful, funny, cool, CAST(ts AS DATE) AS date,
               CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, stars = 3 AS is_ambiguous, language
        FROM raw_reviews"""),
    "undated": (("raw_reviews",), f"""
        SELECT review_id, business_id AS product_id, user_id AS reviewer_id, stars, {_strip("text")} AS text,
               CAST(length(text) AS INT) AS text_length, CAST(len(string_split(text, ' ')) AS INT) AS word_count,
               stars = 3 AS is_ambiguous, language, p_type AS category
        FROM raw_reviews LEFT JOIN part ON p_partkey = business_id"""),
    "raw_order_reviews": ((), """
        SELECT o.o_orderkey AS review_id, o.o_orderkey AS order_id,
               CAST(1 + (o.o_orderkey * 7 + o.o_custkey) % 5 AS INT) AS review_score,
               CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'title ' || CAST(o.o_orderkey % 9 AS VARCHAR) END AS title,
               CASE WHEN o.o_orderkey % 5 < 2 THEN NULL WHEN o.o_orderkey % 25 = 2 THEN '' ELSE d.text END AS message,
               CAST(o.o_orderdate AS DATE) + CAST(1 + o.o_orderkey % 14 AS INT) AS review_date
        FROM orders o CROSS JOIN (SELECT count(*) AS n FROM documents) dn JOIN documents d ON d.doc_id = o.o_orderkey % dn.n
        WHERE o.o_orderkey % 10 < 8"""),
    "order_reviews": (("raw_order_reviews",), f"""
        SELECT *, CAST(length(text) AS INT) AS text_length, CAST(len(string_split(text, ' ')) AS INT) AS word_count,
               CAST(year(review_date) AS INT) AS year, CAST(month(review_date) AS INT) AS month
        FROM (SELECT review_id, order_id, review_score,
                     {_strip("CASE WHEN message IS NOT NULL THEN coalesce(title, '') || ' ' || message ELSE title END")} AS text,
                     message IS NOT NULL AND message <> '' AS has_comment, review_score = 3 AS is_ambiguous,
                     'pt' AS language, review_date
              FROM raw_order_reviews) s"""),
    "items": ((), """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice AS price, l_extendedprice * l_tax AS freight_value FROM lineitem"""),
    "totals": (("items",), """
        SELECT order_id, sum(price) AS order_total, sum(freight_value) AS freight_total, count(*) AS item_count
        FROM items GROUP BY order_id"""),
    "shop_orders": (("totals",), """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_orderdate AS purchase_date,
               CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
               CAST(isodow(o_orderdate) AS INT) AS day_of_week, order_total, freight_total, item_count
        FROM orders LEFT JOIN totals ON order_id = o_orderkey"""),
    "order_items": (("items",), """
        SELECT i.order_id, i.order_item_id, o_custkey AS customer_id, i.product_id, i.seller_id,
               o_orderstatus AS order_status, CAST(o_orderdate AS DATE) AS purchase_date,
               CAST(year(o_orderdate) AS INT) AS purchase_year, CAST(month(o_orderdate) AS INT) AS purchase_month,
               CAST(isodow(o_orderdate) AS INT) AS purchase_dow, i.price, i.freight_value,
               i.price + i.freight_value AS total_value, p_type AS category_pt,
               replace(lower(p_type), ' ', '_') AS category_en,
               CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey % 20 AS INT) END AS delivery_days
        FROM items i JOIN orders ON o_orderkey = i.order_id LEFT JOIN part ON p_partkey = i.product_id"""),
    "raw_users": ((), f"""
        SELECT c_custkey AS user_id, c_name AS name, CAST(c_custkey * 13 % 400 AS INT) AS review_count,
               DATE '2010-01-01' + CAST(c_custkey * 37 % 3000 AS INT) AS yelping_since,
               CAST(c_custkey * 7 % 90 AS INT) AS fans, CAST(c_custkey % 50 AS INT) AS useful,
               CAST(c_custkey % 20 AS INT) AS funny, CAST(c_custkey % 30 AS INT) AS cool,
               1.0::DOUBLE + (c_custkey % 41) / 10.0::DOUBLE AS average_stars,
               CASE WHEN c_custkey % 3 = 0 THEN 'None' ELSE repeat('u, ', CAST(c_custkey % 6 AS INT)) || 'u' END AS friends,
               CASE WHEN c_custkey % 4 = 0 THEN '2010,2011,20' WHEN c_custkey % 4 = 1 THEN '2015' ELSE '' END AS elite,
               {_COMPLIMENTS} FROM customer"""),
    "users": (("raw_users",), f"""
        SELECT user_id, name, review_count, yelping_since, useful, funny, cool, fans, average_stars,
               CAST(CASE WHEN lower(friends) IN ('', 'none') THEN 0 ELSE len(string_split(friends, ',')) END AS INT) AS friends_count,
               CAST(len(regexp_extract_all(elite, '[0-9]{{4}}')) AS INT) AS elite_years_count,
               len(regexp_extract_all(elite, '[0-9]{{4}}')) > 0 AS is_elite, useful + funny + cool AS total_votes_given,
               {" + ".join("compliment_" + n for n in COMPLIMENTS)} AS total_compliments
        FROM raw_users"""),
    "ranked_users": (("users",), """
        SELECT u.*, 0.0::DOUBLE + u.fans / greatest(m.f, 1) * 0.3::DOUBLE + total_compliments / greatest(m.c, 1) * 0.2::DOUBLE
                    + review_count / greatest(m.r, 1) * 0.2::DOUBLE + friends_count / greatest(m.k, 1) * 0.1::DOUBLE
                    + CAST(is_elite AS INT) * 0.2::DOUBLE AS influence_score
        FROM users u CROSS JOIN (SELECT max(fans) f, max(total_compliments) c, max(review_count) r, max(friends_count) k FROM users) m"""),
    "raw_businesses": ((), """
        SELECT p_partkey AS business_id, p_name AS name, 'S' || CAST(p_partkey % 17 AS VARCHAR) AS state,
               'C' || CAST(p_partkey % 97 AS VARCHAR) AS city, CAST(10000 + p_partkey % 90000 AS VARCHAR) AS postal_code,
               CAST(p_partkey % 180 - 90 AS DOUBLE) AS latitude, CAST(p_partkey % 360 - 180 AS DOUBLE) AS longitude,
               1.0::DOUBLE + (p_partkey % 9) / 2.0::DOUBLE AS stars, CAST(p_partkey % 2 AS INT) AS is_open,
               CAST(p_partkey % 120 AS INT) AS review_count,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type || ', ' || p_brand END AS categories FROM part"""),
    "businesses": (("raw_businesses",), f"""
        SELECT business_id, {_strip("name")} AS name, city, state, postal_code, latitude, longitude, stars, review_count,
               is_open, coalesce(categories, '') AS categories,
               CAST(CASE WHEN coalesce(categories, '') = '' THEN 0 ELSE len(string_split(categories, ', ')) END AS INT) AS category_count
        FROM raw_businesses"""),
    "corpus": (("reviews", "undated", "order_reviews"), """
        SELECT 'reviews' AS dataset, review_id, stars, text, text_length, language, NULL AS category, NULL::BOOLEAN AS has_comment FROM reviews
        UNION ALL SELECT 'undated', review_id, stars, text, text_length, language, category, NULL FROM undated
        UNION ALL SELECT 'orders', review_id, review_score, text, text_length, language, NULL, has_comment FROM order_reviews"""),
    "lexicon": ((), f"""SELECT * FROM (VALUES {_rows(
        [(w, 1) for w in sorted(DEFAULT_LEXICON.positive)]
        + [(w, -1) for w in sorted(DEFAULT_LEXICON.negative - DEFAULT_LEXICON.positive)])}) v(word, sign)"""),
    "keywords": ((), f"""SELECT * FROM (VALUES {_rows(
        [(a, w) for a in DEFAULT_TAXONOMY.aspects for w in sorted(DEFAULT_TAXONOMY.keywords[a])])}) v(aspect, word)"""),
    # Scored texts: "texts(review_id, text)" is supplied by the query.
    "cleaned": ((), f"SELECT *, {_clean_ml('text')} AS clean FROM texts"),
    "words": (("cleaned",), """
        SELECT review_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS spot
        FROM (SELECT review_id, string_split(clean, ' ') AS ws FROM cleaned WHERE clean <> '') s"""),
    "polar": (("words", "lexicon"), "SELECT review_id, spot, sign FROM words JOIN lexicon USING (word)"),
    "polarity": (("cleaned", "polar"), f"""
        SELECT review_id, score, {_cut_label("score", "0.05")} AS label, clean
        FROM (SELECT c.review_id, c.clean, coalesce(round((p.pos - p.neg) / (p.pos + p.neg), 4), 0) AS score
              FROM cleaned c LEFT JOIN (SELECT review_id, {_n("sign = 1")} AS pos, {_n("sign = -1")} AS neg
                                        FROM polar GROUP BY review_id) p USING (review_id)) s"""),
    "hits": (("words", "keywords"), "SELECT DISTINCT review_id, aspect, spot FROM words JOIN keywords USING (word)"),
    "mentions": (("hits", "polar", "cleaned", "keywords"), """
        SELECT m.review_id, m.aspect,
               CASE WHEN coalesce(b.balance, 0) > 0 THEN 'positive' WHEN coalesce(b.balance, 0) < 0 THEN 'negative' ELSE 'neutral' END AS sentiment
        FROM (SELECT DISTINCT review_id, aspect FROM hits
              UNION SELECT c.review_id, k.aspect FROM cleaned c JOIN keywords k ON contains(k.word, ' ') AND contains(c.clean, k.word)) m
        LEFT JOIN (SELECT h.review_id, h.aspect, sum(p.sign) AS balance FROM hits h
                   JOIN polar p ON p.review_id = h.review_id AND abs(p.spot - h.spot) <= 5 GROUP BY 1, 2) b
               ON b.review_id = m.review_id AND b.aspect = m.aspect"""),
    "gold": (("polarity",), f"""
        SELECT r.*, CASE WHEN text_rule THEN p.score ELSE (r.stars - 3) / 2.0::DOUBLE END AS sentiment_score,
               CASE WHEN text_rule THEN p.label ELSE {_stars_label("r.stars")} END AS sentiment_label,
               CASE WHEN text_rule THEN abs(p.score) ELSE 1.0 END AS sentiment_confidence,
               'lexicon_polarity_v1' AS model_version
        FROM (SELECT *, language = 'en' AND length({_strip("text")}) > 10 AS text_rule FROM texts) r
        JOIN polarity p USING (review_id)"""),
    "weekly": (("shop_orders", "order_reviews"), _weekly := """
        SELECT week, coalesce(order_count, 0) AS order_count, coalesce(total_revenue, 0) AS total_revenue,
               coalesce(total_items, 0) AS total_items, coalesce(review_count, 0) AS review_count,
               coalesce(a, avg(a) OVER ()) AS avg_review_score, coalesce(s, avg(s) OVER ()) AS std_review_score
        FROM (SELECT c.week, o.*, r.review_count,
                     last_value(r.m IGNORE NULLS) OVER (ORDER BY c.week) AS a,
                     last_value(r.sd IGNORE NULLS) OVER (ORDER BY c.week) AS s
              FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week
                    FROM (SELECT min(week) AS lo, max(week) AS hi FROM
                          (SELECT CAST(date_trunc('week', purchase_date) AS DATE) + 6 AS week FROM __ORDERS__
                           UNION ALL SELECT CAST(date_trunc('week', review_date) AS DATE) + 6 FROM order_reviews) a) b) c
              LEFT JOIN (SELECT CAST(date_trunc('week', purchase_date) AS DATE) + 6 AS ow, count(*) AS order_count,
                                sum(order_total) AS total_revenue, sum(item_count)::BIGINT AS total_items
                         FROM __ORDERS__ GROUP BY 1) o ON o.ow = c.week
              LEFT JOIN (SELECT CAST(date_trunc('week', review_date) AS DATE) + 6 AS rw, count(*) AS review_count,
                                avg(review_score) AS m, stddev_samp(review_score) AS sd
                         FROM order_reviews GROUP BY 1) r ON r.rw = c.week) s"""),
    "weekly_frame": (("weekly",), """
        SELECT * FROM (
            SELECT *, lag(total_revenue, 1) OVER w AS revenue_lag_1, lag(total_revenue, 2) OVER w AS revenue_lag_2,
                   lag(total_revenue, 4) OVER w AS revenue_lag_4, lag(order_count, 1) OVER w AS orders_lag_1,
                   avg(total_revenue) OVER (ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS revenue_roll_4,
                   avg(total_revenue) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS roll_current,
                   CAST(weekofyear(week) AS INT) AS week_of_year, CAST(month(week) AS INT) AS month
            FROM weekly WINDOW w AS (ORDER BY week)) s
        WHERE revenue_lag_1 IS NOT NULL AND revenue_lag_2 IS NOT NULL AND revenue_lag_4 IS NOT NULL"""),
    "product_scores": (("order_reviews", "items"), """
        SELECT product_id, count(*) AS n, sum(review_score) AS score_sum, count(review_score) AS review_count
        FROM order_reviews r JOIN orders o ON o.o_orderkey = r.order_id LEFT JOIN items i ON i.order_id = r.order_id
        GROUP BY product_id"""),
    "product_frame": (("product_scores", "items"), """
        SELECT s.product_id, s.times_sold, s.avg_price, s.total_revenue, r.score_sum / r.review_count AS avg_review_score,
               r.review_count, p_type AS product_category_name, p_size * 10 AS product_weight_g
        FROM (SELECT product_id, count(*) AS times_sold, round(round(sum(price), 2) / count(price), 2) AS avg_price, sum(price) AS total_revenue
              FROM items GROUP BY product_id) s
        LEFT JOIN product_scores r ON r.product_id = s.product_id LEFT JOIN part ON p_partkey = s.product_id"""),
}
_VIEWS["weekly"] = (_VIEWS["weekly"][0], _weekly.replace("__ORDERS__", "shop_orders"))


def _sql(body: str, *views: str, **extra: str) -> str:
    """A standalone query: the named tables, and everything they read, become common table expressions."""
    placed: dict[str, str] = {}

    def place(name: str) -> None:
        if name in placed:
            return
        if name in extra:
            text = extra[name]
            for needed in sorted(_VIEWS):
                if f" {needed} " in f" {text} ":
                    place(needed)
            placed[name] = text
            return
        needs, text = _VIEWS[name]
        for needed in (*(("texts",) if " texts" in text else ()), *needs):
            place(needed)
        placed[name] = text

    for name in (*extra, *views):
        place(name)
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in placed.items())
    return f"WITH {ctes}\n{body}" if ctes else body


TEXTS_REVIEWS = "SELECT review_id, stars, text, language, user_id, business_id, year, month, date, text_length FROM reviews "
TEXTS_RAW = "SELECT review_id, stars, text, language FROM raw_reviews "
_CORR = (
    "round(coalesce(covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * "
    "stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0), 0), {digits})"
)


def _corr(x: str, y: str, digits: int = 4) -> str:
    return _CORR.format(x=f"CAST({x} AS DOUBLE)", y=f"CAST({y} AS DOUBLE)", digits=digits)


def _scored(score: str, label: str, confidence: str, ambiguous: str, model: str, source: str) -> str:
    return (
        f"SELECT review_id, {score} AS sentiment_score, {label} AS sentiment_label, {confidence} AS sentiment_confidence, "
        f"{ambiguous} AS sentiment_is_ambiguous, {model} AS model_version FROM {source}"
    )


def _hits(side: str, language: str) -> str:
    return " + ".join(f"CAST(contains(t, {_q(w)}) AS INT)" for w in HEURISTIC_WORDS[language][side])


def _heuristic(source: str) -> str:
    side = lambda s: (
        f"CASE language WHEN 'es' THEN {_hits(s, 'es')} WHEN 'pt' THEN {_hits(s, 'pt')} ELSE {_hits(s, 'other')} END"
    )
    return f"""(SELECT *, CASE WHEN p > n THEN least(0.5::DOUBLE + p * 0.1::DOUBLE, 1.0::DOUBLE)
                       WHEN n > p THEN greatest(-0.5::DOUBLE - n * 0.1::DOUBLE, -1.0::DOUBLE) ELSE 0.0 END AS hscore,
                   CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS hlabel,
                   round(abs(p - n) / greatest(p + n, 1), 4) AS hconf
            FROM (SELECT *, {side("positive")} AS p, {side("negative")} AS n
                  FROM (SELECT *, lower(coalesce(text, '')) AS t FROM {source}) a) b)"""


def _distribution(where: str) -> str:
    return f"""SELECT *, {_pct("positive", "total_analyzed", 1)} AS positive_pct, {_pct("neutral", "total_analyzed", 1)} AS neutral_pct,
               {_pct("negative", "total_analyzed", 1)} AS negative_pct,
               round((positive - negative) / nullif(total_analyzed, 0), 3) AS average_sentiment,
               CASE WHEN (positive - negative) / total_analyzed > 0.2 THEN 'positive'
                    WHEN (positive - negative) / total_analyzed < -0.2 THEN 'negative' WHEN total_analyzed > 0 THEN 'neutral' END AS sentiment_label
        FROM (SELECT {_n("length(clean) > 5")} AS total_analyzed, (SELECT count(*) FROM source) AS original_count,
                     {", ".join(_n(f"length(clean) > 5 AND label = '{s}'") + f" AS {s}" for s in LABELS)}
              FROM texts JOIN polarity USING (review_id) WHERE {where}) s"""


def _aspect_table(keep: str) -> str:
    return f"""SELECT aspect, count, round(count / reviews_with_aspects * 100, 1) AS percentage, positive, neutral, negative,
               (SELECT count(text) FROM texts) AS total_reviews_analyzed, reviews_with_aspects,
               sum(count) OVER ()::BIGINT AS total_aspect_mentions,
               row_number() OVER (ORDER BY count DESC, aspect) <= 5 AS is_top
        FROM (SELECT aspect, count(*) AS count, {", ".join(_n(f"sentiment = '{s}'") + f" AS {s}" for s in LABELS)}
              FROM kept GROUP BY aspect) a CROSS JOIN (SELECT count(DISTINCT review_id) AS reviews_with_aspects FROM kept) k"""


def _kept(condition: str) -> str:
    return f"SELECT m.* FROM mentions m JOIN polarity p USING (review_id) WHERE length(p.clean) >= 5 AND {condition}"


_COUNT_CORR = "SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n, {r} AS r FROM {t}"


def _metrics_by(groups: str, source: str) -> str:
    """Weighted metrics of (groups, label, prediction) rows."""
    return f"""SELECT {groups}, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 4) AS accuracy,
               round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall,
               round(sum(f * support) / sum(support), 4) AS f1
        FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f
              FROM (SELECT a.{groups}, a.label, a.support, a.tp, coalesce(a.tp / nullif(g.guessed, 0), 0) AS p, a.tp / a.support AS r
                    FROM (SELECT {groups}, label, count(*) AS support, {_n("label = prediction")} AS tp FROM {source} GROUP BY 1, 2) a
                    LEFT JOIN (SELECT {groups}, prediction, count(*) AS guessed FROM {source} GROUP BY 1, 2) g
                           ON g.{groups} = a.{groups} AND g.prediction = a.label) s) t
        GROUP BY {groups}"""


def _profile_row(column: str, dtype: str, numeric: bool, source: str) -> str:
    stats = (
        f"CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, round(avg({column}), 2) AS mean"
        if numeric else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean"
    )
    return (
        f"SELECT '{column}' AS column_name, '{dtype}' AS dtype, count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"{stats}, round((count(*) - count({column})) / count(*) * 100, 2) AS null_pct FROM {source}"
    )


def _cleaning(expression: str) -> str:
    return _sql(f"SELECT review_id, {expression} AS cleaned FROM raw_reviews", "raw_reviews")


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # --- silver tables ---
    out["silver_reviews"] = _sql("SELECT * FROM reviews", "reviews")
    out["silver_users"] = _sql("SELECT * FROM users", "users")
    out["user_years_active"] = _sql(
        "SELECT user_id, CAST(datesub('year', yelping_since, (SELECT max(yelping_since) FROM users)) AS SMALLINT) AS years_active FROM users", "users")
    out["silver_businesses"] = _sql("SELECT * FROM businesses", "businesses")
    out["silver_reviews_undated"] = _sql("SELECT * FROM undated", "undated")
    out["silver_orders"] = _sql(
        "SELECT * REPLACE (round(order_total, 2) AS order_total, round(freight_total, 3) AS freight_total) FROM shop_orders", "shop_orders")
    out["silver_order_reviews"] = _sql(
        "SELECT review_id, order_id, review_score, text, text_length, word_count, has_comment, is_ambiguous, language, "
        "strftime(review_date, '%Y-%m-%d 00:00:00') AS review_creation_date, "
        "strftime(review_date, '%Y-%m-%d 00:00:00') AS review_answer_timestamp FROM order_reviews", "order_reviews")
    out["silver_order_items"] = _sql(
        "SELECT * REPLACE (round(freight_value, 3) AS freight_value, round(total_value, 3) AS total_value) FROM order_items", "order_items")
    out["order_totals"] = _sql(
        "SELECT order_id, round(order_total, 2) AS order_total, round(freight_total, 3) AS freight_total, item_count FROM totals", "totals")
    out["unified_reviews"] = _sql(
        "SELECT dataset, language, count(*) AS n, count(stars) AS rated, count(category) AS with_category, "
        "count(has_comment) AS with_flag, sum(text_length)::BIGINT AS characters FROM corpus GROUP BY 1, 2", "corpus")
    tables = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations",
    )
    out["table_inventory"] = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, true AS exists, count(*) AS row_count, "
        f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {n}))::INT AS column_count FROM {n}" for n in tables
    ) + " UNION ALL SELECT 'not_written', false, NULL, NULL"

    # --- review aggregates ---
    out["reviews_by_stars"] = _sql(
        "SELECT stars, count(*) AS count, round(count(*) / (SELECT count(*) FROM reviews) * 100, 2) AS percentage FROM reviews GROUP BY stars", "reviews")
    out["rating_summary"] = _sql(
        f"SELECT count(*) AS total_reviews, {_n('stars >= 4')} AS positive_count, {_n('stars <= 2')} AS negative_count, "
        f"{_n('stars = 3')} AS ambiguous_count, round({_n('stars >= 4')} / count(*) * 100, 1) AS positive_pct, "
        f"round({_n('stars <= 2')} / count(*) * 100, 1) AS negative_pct, round({_n('stars = 3')} / count(*) * 100, 1) AS ambiguous_pct FROM reviews", "reviews")
    monthly = (
        f"SELECT year, month, count(*) AS review_count, round(avg(review_score), 2) AS avg_stars, {_n('is_ambiguous')} AS ambiguous_count, "
        f"round(avg(text_length)) AS avg_text_length, round({_n('is_ambiguous')} / count(*) * 100, 1) AS pct_ambiguous FROM order_reviews"
    )
    out["reviews_by_month"] = _sql(f"{monthly} GROUP BY 1, 2", "order_reviews")
    out["reviews_by_month_year"] = _sql(f"{monthly} WHERE year = 1997 GROUP BY 1, 2", "order_reviews")
    spread = monthly.replace(" FROM order_reviews", ", round(stddev_samp(review_score), 4) AS std_stars FROM order_reviews")
    out["reviews_by_month_merged"] = _sql(f"{spread} GROUP BY 1, 2", "order_reviews")
    out["column_distribution"] = _sql(
        "SELECT language, count(*) AS count, round(count(*) / (SELECT count(*) FROM reviews) * 100, 2) AS percentage, "
        "(SELECT count(*) FROM (SELECT DISTINCT language FROM reviews) d) AS unique_values, (SELECT count(*) FROM reviews) AS total_rows "
        "FROM reviews GROUP BY language ORDER BY count DESC, language NULLS FIRST LIMIT 50", "reviews")
    out["top_entities_count"] = _sql(
        "SELECT user_id, count(*) AS count FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "reviews")
    out["top_entities_avg_stars"] = _sql(
        "SELECT business_id, count(*) AS count, round(avg(stars), 2) AS avg_stars FROM reviews GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10", "reviews")
    out["top_entities_revenue"] = _sql(
        "SELECT customer_id, count(*) AS count, round(sum(order_total), 2) AS total_revenue FROM shop_orders GROUP BY 1 "
        "ORDER BY 3 DESC NULLS LAST, 1 LIMIT 10", "shop_orders")
    edges = [0, 50, 200, 500, 1000, 5000]
    label = "CASE WHEN text_length <= 0 THEN '<=0' " + " ".join(
        f"WHEN text_length <= {b} THEN '{a}-{b}'" for a, b in zip(edges, edges[1:])) + " WHEN text_length > 5000 THEN '>5000' END"
    rank = "CASE WHEN text_length <= 0 THEN 0 " + " ".join(
        f"WHEN text_length <= {b} THEN {i}" for i, b in enumerate(edges[1:], 1)) + " WHEN text_length > 5000 THEN 6 END"
    out["by_text_length"] = _sql(
        f"SELECT {rank} AS bin_order, {label} AS length_bin, count(*) AS count, round(avg(stars), 2) AS avg_stars, "
        f"{_n('is_ambiguous')} AS ambiguous_count, round(count(*) / (SELECT count(*) FROM reviews) * 100, 1) AS pct, "
        f"round({_n('is_ambiguous')} / count(*) * 100, 1) AS pct_ambiguous FROM reviews GROUP BY 1, 2", "reviews")
    length = lambda c: f"coalesce(round(avg(text_length) FILTER (WHERE {c})), 0)"
    out["ambiguous_stats"] = _sql(
        f"SELECT count(*) AS total_reviews, {_n('is_ambiguous')} AS ambiguous_count, {length('is_ambiguous')} AS avg_text_length_ambiguous, "
        f"{length('NOT is_ambiguous')} AS avg_text_length_non_ambiguous, {_n('stars >= 4')} AS positive_count, {_n('stars <= 2')} AS negative_count, "
        f"{length('stars >= 4')} AS positive_avg_length, {length('stars <= 2')} AS negative_avg_length, "
        f"round({_n('is_ambiguous')} / count(*) * 100, 2) AS ambiguous_pct FROM reviews", "reviews")
    out["ambiguous_comparison"] = _sql(
        "SELECT is_ambiguous, round(avg(text_length), 2) AS avg_text_length, round(avg(word_count), 2) AS avg_word_count, "
        "round(avg(useful), 4) AS avg_useful_votes, round(avg(funny), 4) AS avg_funny_votes, round(avg(cool), 4) AS avg_cool_votes "
        "FROM reviews GROUP BY 1", "reviews")
    out["text_stats"] = _sql(
        f"SELECT round(avg(text_length), 2) AS avg_length, median(text_length) AS median_length, min(text_length) AS min_length, "
        f"max(text_length) AS max_length, round(stddev_samp(text_length), 2) AS std_length, round(avg(word_count), 2) AS avg_words, "
        f"median(word_count) AS median_words, {_n('text_length < 10')} AS very_short, {_n('text_length = 0')} AS empty FROM reviews", "reviews")
    out["text_by_stars"] = _sql(
        "SELECT review_score, round(avg(text_length), 2) AS avg_length, median(text_length) AS median_length, "
        "round(avg(word_count), 2) AS avg_words, count(*) AS count FROM order_reviews WHERE has_comment GROUP BY 1", "order_reviews")
    out["reviews_by_year"] = _sql(
        "SELECT year, count(*) AS count, round(avg(review_score), 4) AS avg_stars FROM order_reviews GROUP BY 1", "order_reviews")
    out["by_weekday"] = _sql("SELECT CAST(isodow(date) AS INT) AS day_of_week, count(*) AS count FROM reviews GROUP BY 1", "reviews")
    out["star_distribution"] = _sql(
        f"""SELECT star, count, pct AS percentage, total, mean, std, round(p4 + p5, 2) AS pct_positive, round(p1 + p2, 2) AS pct_negative,
                   round(p4 + p5, 2) > 60 OR round(p1 + p2, 2) > 60 AS is_imbalanced
            FROM (SELECT CAST(g.star AS INT) AS star, count(r.stars) AS count, round(count(r.stars) / any_value(t.total) * 100, 2) AS pct
                  FROM (SELECT unnest(range(1, 6)) AS star) g CROSS JOIN (SELECT count(*) AS total FROM reviews) t
                  LEFT JOIN reviews r ON r.stars = g.star GROUP BY 1) s
            CROSS JOIN (SELECT count(*) AS total, round(avg(stars), 2) AS mean, round(stddev_pop(stars), 2) AS std,
                               {", ".join("round(" + _n(f"stars = {k}") + f" / count(*) * 100, 2) AS p{k}" for k in range(1, 6))} FROM reviews) m""", "reviews")
    per_business = (
        f"SELECT business_id, count(*) AS review_count_calc, round(avg(stars), 2) AS avg_review_stars, "
        f"round(avg(text_length)) AS avg_text_length, {_n('is_ambiguous')} AS ambiguous_count FROM reviews GROUP BY 1"
    )
    out["reviews_per_business"] = _sql(per_business, "reviews")
    out["business_review_corr"] = _sql(
        f"SELECT count(*) AS businesses_analyzed, {_corr('b.stars', 'r.avg_review_stars')} AS correlation_business_vs_review_stars, "
        f"round(avg(b.stars), 2) AS avg_business_stars, round(avg(r.avg_review_stars), 2) AS avg_review_stars "
        f"FROM businesses b JOIN ({per_business}) r USING (business_id) WHERE review_count_calc >= 3", "reviews", "businesses")
    out["filtered_reviews"] = _sql(
        "SELECT review_id, stars, date, language, text_length FROM reviews WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' "
        "AND stars IN (2, 4, 5) AND stars >= 2 AND NOT is_ambiguous AND language = 'en'", "reviews")
    out["generic_aggregate"] = _sql(
        "SELECT language, stars, round(avg(text_length), 2) AS avg_text_length FROM reviews WHERE date >= DATE '2024-01-03' "
        "AND NOT is_ambiguous GROUP BY 1, 2", "reviews")

    # --- sales ---
    out["sales_by_month"] = _sql(
        "SELECT year, month, count(*) AS order_count, round(sum(order_total), 2) AS total_revenue, round(round(sum(order_total), 2) / count(order_total), 2) AS avg_order_value, "
        "sum(item_count)::BIGINT AS total_items FROM shop_orders GROUP BY 1, 2", "shop_orders")
    out["sales_summary"] = _sql(
        "SELECT round(sum(order_total), 2) AS total_revenue, count(*) AS total_orders, "
        "coalesce(round(round(sum(order_total), 2) / nullif(count(*), 0), 2), 0) AS avg_order_value FROM shop_orders", "shop_orders")
    out["orders_by_month"] = _sql(
        "SELECT year, month, count(*) AS orders_count, year::VARCHAR || '-' || lpad(month::VARCHAR, 2, '0') AS year_month FROM shop_orders GROUP BY 1, 2", "shop_orders")
    out["revenue_by_month"] = _sql(
        "SELECT purchase_year AS year, purchase_month AS month, round(sum(price), 2) AS total_revenue, round(round(sum(price), 2) / count(price), 2) AS avg_price "
        "FROM order_items GROUP BY 1, 2", "order_items")
    out["sales_by_category"] = _sql(
        "SELECT category_en, count(DISTINCT order_id) AS order_count, round(sum(price), 2) AS total_revenue, "
        "round(round(sum(price), 2) / count(DISTINCT order_id), 2) AS avg_order_value FROM order_items GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20", "order_items")
    out["revenue_by_category"] = _sql(
        "SELECT p_type AS product_category_name, round(sum(price), 2) AS total_revenue, count(*) AS items_sold "
        "FROM items LEFT JOIN part ON p_partkey = product_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "items")
    out["rating_by_category_min100"] = _sql(
        "SELECT p_type AS product_category_name, round(avg(review_score), 4) AS avg_score, count(review_score) AS review_count "
        "FROM order_reviews r JOIN orders o ON o.o_orderkey = r.order_id LEFT JOIN items i ON i.order_id = r.order_id "
        "LEFT JOIN part ON p_partkey = i.product_id GROUP BY 1 HAVING count(review_score) >= 100", "order_reviews", "items")
    out["product_features"] = _sql(
        "SELECT * REPLACE (round(total_revenue, 2) AS total_revenue, "
        "round(avg_review_score, 4) AS avg_review_score, review_count::BIGINT AS review_count) FROM product_frame", "product_frame")
    out["product_corr"] = _sql(
        f"SELECT {_corr('avg_review_score', 'times_sold')} AS corr_score_sold, {_corr('avg_review_score', 'total_revenue')} AS corr_score_revenue, "
        f"{_corr('avg_price', 'times_sold')} AS corr_price_sold FROM product_frame WHERE review_count >= 3", "product_frame")
    out["score_metrics"] = _sql(
        f"SELECT review_score, count(*) AS order_count, round(round(sum(order_total), 2) / count(order_total), 2) AS avg_order_value, round(sum(order_total), 2) AS total_revenue, "
        f"{_n('has_comment')} AS with_comment FROM shop_orders JOIN order_reviews USING (order_id) GROUP BY 1", "shop_orders", "order_reviews")
    out["score_value_corr"] = _sql(
        f"SELECT count(*) AS orders_with_reviews, {_corr('review_score', 'coalesce(order_total, 0)')} AS correlation_score_vs_value "
        "FROM shop_orders JOIN order_reviews USING (order_id)", "shop_orders", "order_reviews")
    out["price_by_score"] = _sql(
        "SELECT review_score, round(round(sum(order_total), 2) / count(order_total), 2) AS avg_price, round(median(order_total), 3) AS median_price, count(*) AS count "
        "FROM order_reviews LEFT JOIN shop_orders USING (order_id) WHERE order_total IS NOT NULL GROUP BY 1", "shop_orders", "order_reviews")
    out["status_counts"] = "SELECT o_orderstatus AS order_status, count(*) AS count FROM orders GROUP BY 1"
    out["price_stats"] = _sql(
        "SELECT round(round(sum(price), 2) / count(price), 2) AS avg_price, min(price) AS min_price, max(price) AS max_price, round(median(price), 3) AS median_price, "
        "round(sum(price), 2) AS total_revenue, round(round(sum(freight_value), 4) / count(freight_value), 2) AS avg_freight, "
        "round(sum(price) + sum(freight_value), 1) AS revenue_with_freight FROM items", "items")
    out["product_stats"] = (
        "SELECT round(avg(length(p_name)), 2) AS avg_name_length, round(avg(length(p_type)), 2) AS avg_desc_length, "
        "round(avg(p_size % 6), 2) AS avg_photos, round(avg(p_size * 10), 2) AS avg_weight_g, count(DISTINCT p_type) AS unique_categories FROM part")
    out["top_product_categories"] = (
        "SELECT p_type AS product_category_name, count(*) AS product_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
    answered = ("SELECT year, month, round(avg(review_score), 2) AS avg_review_score, count(*) AS review_count FROM order_reviews GROUP BY 1, 2")
    out["sales_features"] = _sql(
        f"SELECT o.*, r.avg_review_score, r.review_count FROM (SELECT year, month, count(*) AS order_count, round(sum(order_total), 2) AS total_revenue, "
        f"round(round(sum(order_total), 2) / count(order_total), 2) AS avg_order_value, sum(item_count)::BIGINT AS total_items FROM shop_orders GROUP BY 1, 2) o "
        f"LEFT JOIN ({answered}) r USING (year, month)", "shop_orders", "order_reviews")
    out["sales_features_by_category"] = _sql(
        f"SELECT o.*, r.avg_review_score, r.review_count FROM (SELECT purchase_year AS year, purchase_month AS month, category_en, "
        f"count(DISTINCT order_id) AS order_count, round(sum(price), 2) AS total_revenue, "
        f"round(round(sum(price), 2) / count(DISTINCT order_id), 2) AS avg_order_value, count(*) AS total_items FROM order_items GROUP BY 1, 2, 3) o "
        f"LEFT JOIN ({answered}) r USING (year, month)", "order_items", "order_reviews")

    # --- users and businesses ---
    out["user_stats"] = _sql(
        f"SELECT count(*) AS total_users, round(avg(review_count), 1) AS avg_review_count, round(avg(fans), 1) AS avg_fans, "
        f"round(avg(average_stars), 2) AS avg_average_stars, {_n('is_elite')} AS elite_users, "
        f"round({_n('is_elite')} / count(*) * 100, 1) AS elite_pct FROM users", "users")
    out["user_overview"] = _sql(
        "SELECT round(avg(review_count), 2) AS avg_reviews, median(review_count) AS median_reviews, max(review_count) AS max_reviews, "
        "round(avg(friends_count), 2) AS avg_friends, round(avg(fans), 2) AS avg_fans, round(avg(is_elite::INT), 4) AS pct_elite, "
        "round(avg(average_stars), 4) AS avg_avg_stars, round(avg(total_compliments), 2) AS avg_compliments FROM users", "users")
    out["top_reviewers"] = _sql(
        "SELECT user_id, review_count, fans, average_stars FROM users ORDER BY review_count DESC, user_id LIMIT 10", "users")
    out["elite_comparison"] = _sql(
        "SELECT is_elite, count(*) AS count, round(avg(review_count), 2) AS avg_reviews, round(avg(friends_count), 2) AS avg_friends, "
        "round(avg(fans), 2) AS avg_fans, round(avg(average_stars), 4) AS avg_rating, round(avg(total_compliments), 2) AS avg_compliments "
        "FROM users GROUP BY 1", "users")
    out["user_influence"] = _sql(
        "SELECT user_id, is_elite, round(0.0::DOUBLE + review_count / m.r * 0.3::DOUBLE + fans / m.f * 0.3::DOUBLE + useful / m.u * 0.3::DOUBLE "
        "+ is_elite::INT * 0.1::DOUBLE, 4) AS influence_score FROM users "
        "CROSS JOIN (SELECT max(review_count) r, max(fans) f, max(useful) u FROM users) m", "users")
    out["user_influence_capped"] = _sql(
        "SELECT user_id, is_elite, round(least(0.0::DOUBLE + least(fans / 10000, 1) * 0.3::DOUBLE + least(total_compliments / 10000, 1) * 0.2::DOUBLE "
        "+ least(review_count / 5000, 1) * 0.2::DOUBLE + least(friends_count / 5000, 1) * 0.1::DOUBLE + is_elite::INT * 0.2::DOUBLE, 1), 4) "
        "AS influence_score FROM users", "users")
    out["top_influencers"] = _sql(
        "SELECT user_id, name, review_count, fans, is_elite, elite_years_count, round(s, 6) AS influence_score "
        "FROM (SELECT *, influence_score AS s FROM ranked_users ORDER BY influence_score DESC, user_id LIMIT 10) t", "ranked_users")
    nearest = lambda q: (
        f"(SELECT influence_score FROM (SELECT influence_score, row_number() OVER (ORDER BY influence_score) AS k FROM ranked_users) o "
        f"WHERE k = 1 + (SELECT CAST(round((count(*) - 1) * {q}::DOUBLE) AS BIGINT) FROM ranked_users))"
    )
    out["influence_stats"] = _sql(
        f"SELECT round(avg(influence_score), 4) AS mean, round(median(influence_score), 4) AS median, "
        f"round(stddev_samp(influence_score), 4) AS std, round({nearest('0.9')}, 4) AS p90, round({nearest('0.99')}, 4) AS p99 FROM ranked_users", "ranked_users")
    out["business_stats"] = _sql(
        f"SELECT count(*) AS total_businesses, {_n('is_open = 1')} AS open_businesses, count(*) - {_n('is_open = 1')} AS closed_businesses, "
        f"round({_n('is_open = 1')} / count(*) * 100, 1) AS open_pct, round(avg(stars), 2) AS avg_stars, "
        f"round(avg(review_count), 1) AS avg_review_count, round(avg(category_count), 1) AS avg_category_count FROM businesses", "businesses")
    out["top_states"] = _sql(
        "SELECT state, count(*) AS count, round(avg(stars), 2) AS avg_stars FROM businesses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "businesses")
    out["top_cities"] = _sql(
        "SELECT city || ', ' || state AS city_state, count(*) AS city_businesses, round(avg(stars), 2) AS avg_stars FROM businesses "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "businesses")
    out["business_ratings"] = _sql("SELECT stars, count(*) AS count FROM businesses GROUP BY 1", "businesses")
    out["open_counts"] = _sql("SELECT is_open, count(*) AS count FROM businesses GROUP BY 1", "businesses")
    out["category_counts"] = _sql(
        "SELECT category, count(*) AS count FROM (SELECT unnest(string_split(categories, ', ')) AS category FROM businesses WHERE categories <> '') s GROUP BY 1", "businesses")

    # --- profiles and checks ---
    columns = ["name", "state", "city", "postal_code", "latitude", "longitude", "stars", "is_open", "review_count", "categories"]
    out["null_coverage"] = _sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT business_id) AS distinct_keys, count(*) - count({c}) AS null_count, "
        f"round(1 - (count(*) - count({c})) / count(*), 4) AS coverage FROM raw_businesses" for c in columns), "raw_businesses")
    out["numeric_summary"] = _sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 2) AS mean FROM g"
        for c in ("stars", "count", "percentage")), "reviews",
        g="SELECT stars, count(*) AS count, round(count(*) / (SELECT count(*) FROM reviews ) * 100, 2) AS percentage FROM reviews GROUP BY stars")
    kinds = [("order_id", "bigint", True), ("customer_id", "bigint", True), ("order_status", "string", False),
             ("purchase_date", "timestamp_ntz", False), ("year", "int", True), ("month", "int", True), ("day_of_week", "int", True),
             ("order_total", "double", True), ("freight_total", "double", True), ("item_count", "bigint", True)]
    rows = " UNION ALL ".join(_profile_row(*k, "shop_orders") for k in kinds)
    out["table_profile"] = _sql(f"SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max) FROM ({rows}) p", "shop_orders")
    out["profile_column"] = _sql(_profile_row("text_length", "int", True, "order_reviews"), "order_reviews")
    out["available_values"] = _sql("SELECT DISTINCT city FROM businesses ORDER BY city", "businesses")
    out["date_range"] = _sql(
        "SELECT strftime(min(date), '%Y-%m-%d') AS min_date, strftime(max(date), '%Y-%m-%d') AS max_date FROM reviews", "reviews")
    checks = {
        "has_data": "CASE WHEN count(*) > 0 THEN 0 ELSE 1 END", "range:stars": _n("stars NOT BETWEEN 1 AND 5"),
        "range:sentiment_score": _n("sentiment_score NOT BETWEEN -1 AND 1"),
        "domain:sentiment_label": _n("sentiment_label NOT IN ('positive', 'neutral', 'negative')"),
        "required:stars": "0", "required:topic_id": "1",
    }
    out["range_checks"] = _sql(" UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) AS rows_checked, CAST({c} AS BIGINT) AS violations, {c} = 0 AS passed FROM gold"
        for n, c in checks.items()), "gold", texts=TEXTS_REVIEWS)

    # --- text ---
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]".replace(r"\x7f-\x9f", r"\x{7f}-\x{9f}")
    clean_text = f"coalesce({_re(_collapse(_strip('text')), control)}, '')"
    out["clean_text"] = _cleaning(clean_text)
    out["clean_basic"] = _cleaning(_clean_basic("text"))
    out["clean_nlp"] = _cleaning(_clean_nlp("text"))
    out["clean_spanish"] = _cleaning(_clean_letters("text", "a-záéíóúüñ"))
    out["clean_portuguese"] = _cleaning(_clean_letters("text", "a-záàâãéêíóôõúç"))
    out["clean_ml"] = _cleaning(_clean_ml("text"))
    out["text_stats_ws"] = _sql(
        f"SELECT review_id, CAST(length(c) AS INT) AS text_length, CAST(len(regexp_extract_all(c, {_q(f'[^{WS}]+')})) AS INT) AS word_count "
        f"FROM (SELECT review_id, {clean_text} AS c FROM raw_reviews) s", "raw_reviews")
    solid = _re("text", f"[{WS}]+")
    out["text_features"] = _sql(
        f"SELECT review_id, CAST(length(text) AS INT) AS char_count, CAST(w AS INT) AS word_count, "
        f"CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {_strip('s')} <> '')) AS INT) AS sentence_count, "
        f"round(length({solid}) / greatest(w, 1), 2) AS avg_word_length, CAST(length({_re('text', '[^!]')}) AS INT) AS exclamation_count, "
        f"CAST(length({_re('text', '[^?]')}) AS INT) AS question_count, "
        f"round(length({_re('text', r'[^\p{Lu}]')}) / greatest(length(text), 1), 4) AS uppercase_ratio "
        f"FROM (SELECT *, len(regexp_extract_all(text, {_q(f'[^{WS}]+')})) AS w FROM raw_reviews) r", "raw_reviews")
    out["term_counts"] = _sql(
        """SELECT term, count(*) AS count FROM (
               SELECT word AS term FROM kept UNION ALL
               SELECT word || ' ' || next FROM (SELECT word, lead(word) OVER (PARTITION BY review_id ORDER BY spot) AS next FROM kept) b
               WHERE next IS NOT NULL) t
           GROUP BY term ORDER BY count DESC, term LIMIT 200""",
        texts=TEXTS_RAW, kept="SELECT * FROM words WHERE length(word) >= 2")

    # --- sentiment ---
    out["sentiment_baseline"] = _sql(_scored(
        "(stars - 3) / 2.0::DOUBLE", _stars_label("stars"), "1.0::DOUBLE", "stars = 3", "'baseline_stars_v1'", "reviews"), "reviews")
    out["sentiment_lexicon"] = _sql(
        _scored("score", "label", "abs(score)", "label = 'neutral'", "'lexicon_polarity_v1'", "polarity"), "polarity", texts=TEXTS_REVIEWS)
    out["sentiment_heuristic"] = _sql(_scored(
        "round(hscore, 4)", "hlabel", "hconf", "p = n", "'heuristic_' || language || '_v1'", f"{_heuristic('reviews')} h"), "reviews")
    base = "(stars - 3) / 2.0::DOUBLE"
    mixed = f"""(SELECT *, ts * 0.6::DOUBLE + bs * (1 - 0.6::DOUBLE) AS m FROM
        (SELECT t.review_id, {base} AS bs, {_stars_label("stars")} AS bl,
                CASE WHEN language = 'en' AND t.text <> '' OR {{all}} THEN p.score ELSE {base} END AS ts,
                CASE WHEN language = 'en' AND t.text <> '' OR {{all}} THEN p.label ELSE {_stars_label("stars")} END AS tl,
                CASE WHEN language = 'en' AND t.text <> '' OR {{all}} THEN abs(p.score) ELSE 1.0 END AS tc
         FROM texts t JOIN polarity p USING (review_id)) a) b"""
    cut = _cut_label("m", "0.3")
    out["sentiment_combined"] = _sql(_scored(
        "round(m, 4)", cut, "round(least(1.0, tc), 4)", f"{cut} = 'neutral' OR (bl <> tl AND bl <> 'neutral' AND tl <> 'neutral')",
        "'combined_v1'", mixed.format(all="false")), "polarity", texts=TEXTS_REVIEWS)
    out["sentiment_combined_soft"] = _sql(_scored(
        "round(m, 4)", _cut_label("m", "0.05"), "round(least(1.0, tc), 4)", "abs(m) < 0.2 OR bl <> tl",
        "'combined_v2'", mixed.format(all="true")), "polarity", texts=TEXTS_REVIEWS)
    out["ambiguous_reclassified"] = _sql(
        f"SELECT h.review_id, 'neutral' AS original_label, CASE WHEN language = 'en' THEN p.label ELSE hlabel END AS inferred_label, "
        f"CASE WHEN language = 'en' THEN p.score ELSE round(hscore, 4) END AS inferred_score, "
        f"CASE WHEN language = 'en' THEN abs(p.score) ELSE hconf END AS confidence, "
        f"CASE WHEN language = 'en' THEN 'lexicon_polarity_v1' ELSE 'heuristic_' || language || '_v1' END AS model "
        f"FROM {_heuristic('texts')} h JOIN polarity p USING (review_id) WHERE stars = 3", "polarity", texts=TEXTS_REVIEWS)
    out["sentiment_distribution"] = _sql(_distribution("true"), "polarity", texts=TEXTS_REVIEWS, source="SELECT review_id FROM reviews ")
    out["sentiment_distribution_stars3"] = _sql(
        _distribution("stars = 3"), "polarity", texts=TEXTS_REVIEWS, source="SELECT review_id FROM reviews ")
    out["ambiguous_sentiment"] = _sql(
        f"SELECT *, CASE WHEN average_sentiment > 0.10 THEN 'positive' WHEN average_sentiment < -0.10 THEN 'negative' ELSE 'neutral' END AS tendency "
        f"FROM ({_distribution('review_score = 3')}) d", "polarity",
        texts="SELECT review_id, review_score, text FROM order_reviews ", source="SELECT review_id FROM order_reviews ")
    out["gold_features"] = _sql(
        "SELECT review_id, sentiment_score, sentiment_label, sentiment_confidence, model_version FROM gold", "gold", texts=TEXTS_REVIEWS)
    out["gold_sentiment_stats"] = _sql(
        "SELECT sentiment_label, count(*) AS count, (SELECT round(avg(sentiment_score), 3) FROM gold) AS avg_sentiment_score, "
        "false AS has_embeddings, false AS has_topics FROM gold GROUP BY 1", "gold", texts=TEXTS_REVIEWS)
    out["sentiment_by_month"] = _sql(
        f"SELECT 'reviews' AS dataset, year, month, count(*) AS review_count, round(avg(stars), 2) AS avg_stars, round(avg(sentiment_score), 3) AS avg_sentiment, "
        f"round({_n(_q('positive') + ' = sentiment_label')} / count(*) * 100, 2) AS pct_positive, "
        f"round({_n(_q('negative') + ' = sentiment_label')} / count(*) * 100, 2) AS pct_negative, "
        f"round({_n('stars = 3')} / count(*) * 100, 2) AS pct_ambiguous FROM gold GROUP BY 2, 3", "gold", texts=TEXTS_REVIEWS)
    out["sentiment_by_category"] = _sql(
        """SELECT 'undated' AS dataset, g.category, g.review_count, g.avg_stars, g.avg_sentiment, coalesce(t.top_aspects, '') AS top_aspects
           FROM (SELECT category, count(*) AS review_count, round(avg(stars), 2) AS avg_stars, round(avg(sentiment_score), 3) AS avg_sentiment
                 FROM gold GROUP BY category) g
           LEFT JOIN (SELECT category, string_agg(aspect, ',' ORDER BY k) AS top_aspects
                      FROM (SELECT category, aspect, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, aspect) AS k
                            FROM mentions JOIN texts USING (review_id) GROUP BY category, aspect) r
                      WHERE k <= 3 GROUP BY category) t ON t.category IS NOT DISTINCT FROM g.category""",
        "gold", "mentions", texts="SELECT review_id, stars, text, language, category FROM undated ")
    out["user_sentiment_stats"] = _sql(
        f"""SELECT g.user_id, g.total_reviews, g.avg_sentiment, g.sentiment_std, g.pct_positive, g.pct_negative, g.avg_text_length, t.top_categories,
                  round(g.total_reviews / greatest((year(l.d) - year(u.yelping_since)) * 12 + month(l.d) - month(u.yelping_since), 1), 4) AS review_frequency
           FROM (SELECT user_id, count(*) AS total_reviews, round(avg(sentiment_score), 3) AS avg_sentiment,
                        round(stddev_samp(sentiment_score), 3) AS sentiment_std,
                        round({_n("sentiment_label = 'positive'")} / count(*) * 100, 2) AS pct_positive,
                        round({_n("sentiment_label = 'negative'")} / count(*) * 100, 2) AS pct_negative,
                        round(avg(text_length), 1) AS avg_text_length FROM gold GROUP BY user_id) g
           CROSS JOIN (SELECT max(date) AS d FROM texts) l
           LEFT JOIN raw_users u USING (user_id)
           LEFT JOIN (SELECT user_id, string_agg(category, ',' ORDER BY k) AS top_categories
                      FROM (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS k
                            FROM (SELECT x.user_id, unnest(string_split(b.categories, ', ')) AS category
                                  FROM texts x JOIN businesses b USING (business_id) WHERE b.categories <> '') s
                            GROUP BY user_id, category) r
                      WHERE k <= 3 GROUP BY user_id) t USING (user_id)""",
        "gold", "businesses", "raw_users", texts=TEXTS_REVIEWS)

    # --- aspects ---
    out["aspect_mentions"] = _sql("SELECT * FROM mentions", "mentions", texts=TEXTS_REVIEWS)
    out["aspect_mentions_joined"] = out["aspect_mentions"]
    out["aspect_distribution"] = _sql(_aspect_table("true"), "mentions", "polarity", texts=TEXTS_REVIEWS, kept=_kept("true"))
    out["aspects_negative"] = _sql(
        _aspect_table("true"), "mentions", "polarity", texts=TEXTS_REVIEWS, kept=_kept("p.label = 'negative'"))
    aspects = ", ".join(f"('{a}')" for a in DEFAULT_TAXONOMY.aspects)
    share = lambda d: (
        f"coalesce(round({_n(f'm.dataset = {_q(d)}')} / (SELECT count(*) FROM texts WHERE dataset = '{d}') * 100, 1), 0) AS {d}"
    )
    out["aspect_by_source"] = _sql(
        f"SELECT a.aspect, {share('reviews')}, {share('undated')}, {share('orders')} FROM (VALUES {aspects}) a(aspect) "
        "LEFT JOIN (SELECT m.aspect, t.dataset FROM mentions m JOIN texts t USING (review_id)) m USING (aspect) GROUP BY a.aspect",
        "mentions", texts="SELECT dataset || ':' || review_id AS review_id, dataset, text FROM corpus WHERE length(text) > 20")
    out["aspect_sentiment_crosstab"] = _sql(
        "SELECT aspect, " + ", ".join(f"round({_n(f'sentiment = {_q(s)}')} / count(*) * 100, 1) AS {s}_pct" for s in LABELS)
        + " FROM kept GROUP BY aspect", "mentions", "polarity", texts=TEXTS_REVIEWS, kept=_kept("true"))
    out["aspect_overlap_metrics"] = _sql(
        """SELECT overlap, total_extracted, total_annotated, round(overlap / total_extracted, 3) AS precision,
                  round(overlap / total_annotated, 3) AS recall,
                  round(2 * (overlap / total_extracted) * (overlap / total_annotated) / (overlap / total_extracted + overlap / total_annotated), 3) AS f1
           FROM (SELECT (SELECT count(*) FROM mentions) AS total_extracted, (SELECT count(*) FROM noted) AS total_annotated,
                        (SELECT count(*) FROM mentions JOIN noted USING (review_id, aspect)) AS overlap) s""",
        "mentions", texts=TEXTS_RAW,
        noted=f"""SELECT DISTINCT review_id, (SELECT aspect FROM (SELECT aspect, n FROM (VALUES {_rows(
            [(a, i, w) for i, a in enumerate(DEFAULT_TAXONOMY.aspects) for w in sorted(DEFAULT_TAXONOMY.keywords[a] | {a})])}) v(aspect, n, word)
            WHERE v.word = e.entry) f ORDER BY n LIMIT 1) AS aspect
            FROM (SELECT review_id, lower(trim(unnest(string_split(list, ',')))) AS entry
                  FROM (SELECT review_id, CASE review_id % 5 WHEN 0 THEN 'shipping, Price' WHEN 1 THEN 'entrega,service'
                               WHEN 2 THEN 'quality ,unknown' WHEN 3 THEN NULL ELSE 'product,color' END AS list FROM raw_reviews ) s) e
            WHERE aspect IS NOT NULL""")
    order = ", ".join(f"('{a}', {i})" for i, a in enumerate(DEFAULT_TAXONOMY.aspects))
    listed = lambda what, cond: f"coalesce(string_agg({what}, ',' ORDER BY o.k) FILTER (WHERE {cond}), '')"
    usable = f"length({_strip('t.text')}) >= 10"
    out["review_analysis"] = _sql(
        f"""SELECT t.review_id, CASE WHEN length(t.text) > 150 THEN t.text[:150] || '...' ELSE t.text END AS text_preview,
                   CASE WHEN {usable} THEN p.label END AS global_sentiment, CASE WHEN {usable} THEN CAST(coalesce(m.num_aspects, 0) AS INT) END AS num_aspects,
                   CASE WHEN {usable} THEN coalesce(m.aspects, '') END AS aspects,
                   CASE WHEN {usable} THEN coalesce(m.aspect_sentiments, '') END AS aspect_sentiments,
                   CASE WHEN {usable} THEN coalesce(m.positive_aspects, '') END AS positive_aspects,
                   CASE WHEN {usable} THEN coalesce(m.negative_aspects, '') END AS negative_aspects
            FROM texts t JOIN polarity p USING (review_id)
            LEFT JOIN (SELECT review_id, count(*) AS num_aspects, {listed("x.aspect", "true")} AS aspects,
                              {listed("x.aspect || '=' || sentiment", "true")} AS aspect_sentiments,
                              {listed("x.aspect", "sentiment = 'positive'")} AS positive_aspects,
                              {listed("x.aspect", "sentiment = 'negative'")} AS negative_aspects
                       FROM mentions x JOIN (VALUES {order}) o(aspect, k) ON o.aspect = x.aspect GROUP BY review_id) m USING (review_id)""",
        "mentions", "polarity", texts=TEXTS_REVIEWS)

    # --- weekly series ---
    digits = "round(total_revenue, 2) AS total_revenue, round(avg_review_score, 4) AS avg_review_score, round(std_review_score, 4) AS std_review_score"
    out["weekly_series"] = _sql(f"SELECT * REPLACE ({digits}) FROM weekly", "weekly")
    out["weekly_features"] = _sql(
        f"SELECT * EXCLUDE (roll_current) REPLACE ({digits}, round(revenue_lag_1, 2) AS revenue_lag_1, round(revenue_lag_2, 2) AS revenue_lag_2, "
        "round(revenue_lag_4, 2) AS revenue_lag_4, round(revenue_roll_4, 4) AS revenue_roll_4) FROM weekly_frame", "weekly_frame")
    out["weekly_features_current"] = _sql("SELECT week, round(roll_current, 4) AS revenue_roll_4 FROM weekly_frame", "weekly_frame")
    out["latest_weeks"] = _sql(
        "SELECT week, round(total_revenue, 2) AS total_revenue, order_count, week_of_year FROM weekly_frame WHERE total_revenue > 0 "
        "ORDER BY week DESC LIMIT 4", "weekly_frame")
    pairs = [("avg_review_score", "total_revenue"), ("avg_review_score", "order_count"), ("review_count", "total_revenue"), ("review_count", "order_count")]
    out["weekly_corr"] = _sql(" UNION ALL ".join(
        _COUNT_CORR.format(x=x, y=y, r=_corr(x, y), t="weekly_frame") for x, y in pairs), "weekly_frame")
    seven = ["total_revenue", "order_count", "avg_review_score", "review_count", "revenue_lag_1", "revenue_roll_4", "week_of_year"]
    out["monthly_corr"] = _sql(
        " UNION ALL ".join(_COUNT_CORR.format(x=x, y=y, r=_corr(x, y), t="monthly_frame") for x, y in pairs), "shop_orders", "order_reviews",
        monthly_frame="""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY m) AS k FROM (
            SELECT c.m, coalesce(order_count, 0) AS order_count, coalesce(total_revenue, 0) AS total_revenue, coalesce(n, 0) AS review_count,
                   coalesce(a, avg(a) OVER ()) AS avg_review_score
            FROM (SELECT c.m, o.order_count, o.total_revenue, r.n, last_value(r.score IGNORE NULLS) OVER (ORDER BY c.m) AS a
                  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
                        FROM (SELECT min(m) AS lo, max(m) AS hi FROM (SELECT date_trunc('month', purchase_date) AS m FROM shop_orders
                              UNION ALL SELECT date_trunc('month', review_date) FROM order_reviews) x) b) c
                  LEFT JOIN (SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS om, count(*) AS order_count, sum(order_total) AS total_revenue
                             FROM shop_orders GROUP BY 1) o ON o.om = c.m
                  LEFT JOIN (SELECT CAST(date_trunc('month', review_date) AS DATE) AS rm, count(*) AS n, avg(review_score) AS score
                             FROM order_reviews GROUP BY 1) r ON r.rm = c.m) c) d) e WHERE k > 4""")
    out["weekly_corr_matrix"] = _sql(" UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {_corr(x, y)} AS r FROM weekly_frame" for x in seven for y in seven), "weekly_frame")
    out["weekly_cross_corr"] = _sql(
        "SELECT x AS metric, CAST(right(y, 1) AS INT) AS lag, n, r, row_number() OVER (ORDER BY abs(r) DESC, x, y) = 1 AS is_best FROM ("
        + " UNION ALL ".join(
            _COUNT_CORR.format(x=x, y=f"t{k}", r=_corr(x, f"t{k}"), t="led") for x in ("avg_review_score", "review_count") for k in range(3)
        ) + ") s", "weekly_frame",
        led="SELECT *, total_revenue AS t0, lead(total_revenue, 1) OVER (ORDER BY week) AS t1, lead(total_revenue, 2) OVER (ORDER BY week) AS t2 FROM weekly_frame ")
    # Two-sided p of r with v = n - 2 degrees of freedom by the finite series of Student's t, where sin = |r|.
    led = "SELECT *, total_revenue AS t0, lead(total_revenue, 1) OVER (ORDER BY week) AS t1, lead(total_revenue, 2) OVER (ORDER BY week) AS t2 FROM weekly_frame "
    pairs = " UNION ALL ".join(
        _COUNT_CORR.format(x=x, y=f"t{k}", r=_corr(x, f"t{k}", 15), t="led") for x in ("avg_review_score", "review_count") for k in range(3))
    even = "exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(1 - r * r, k)"
    odd = "exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - r * r, k + 0.5)"
    out["weekly_corr_significance"] = _sql(
        "SELECT metric, lag, n, round(r, 4) AS r, is_best, round(p, 4) AS p, coalesce(p < 0.05, false) AS significant FROM ("
        "SELECT x AS metric, CAST(right(y, 1) AS INT) AS lag, n, r, row_number() OVER (ORDER BY abs(r) DESC, x, y) = 1 AS is_best, "
        "CASE WHEN n % 2 = 0 THEN 1 - abs(r) * s ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * s) END AS p FROM ("
        "SELECT x, y, n, r, coalesce(sum(CASE WHEN n % 2 = 0 AND k <= n / 2 - 2 THEN " + even
        + " WHEN n % 2 = 1 AND k <= (n - 5) / 2 THEN " + odd + " END), 0) AS s "
        "FROM c, (SELECT unnest(range((SELECT max(n) FROM c))) AS k) i GROUP BY x, y, n, r) t) q",
        "weekly_frame", led=led, c=pairs.replace(" FROM led", " FROM led "))
    out["forecast_inputs"] = _sql(
        """SELECT CAST(max(week) + 7 AS DATE) AS week, round(max(total_revenue) FILTER (k = 1), 2) AS revenue_lag_1,
                  round(max(total_revenue) FILTER (k = 2), 2) AS revenue_lag_2, round(max(total_revenue) FILTER (k = 4), 2) AS revenue_lag_4,
                  max(order_count) FILTER (k = 1)::DOUBLE AS orders_lag_1, round(avg(total_revenue) FILTER (k <= 4), 4) AS revenue_roll_4,
                  round(max(avg_review_score) FILTER (k = 1), 4) AS avg_review_score, (weekofyear(max(week)) % 52 + 1)::DOUBLE AS week_of_year
           FROM (SELECT *, row_number() OVER (ORDER BY week DESC) AS k FROM weekly
                 WHERE week <= (SELECT max(week) FROM weekly WHERE total_revenue > 0)) s""", "weekly")
    out["group_forecast_inputs"] = _sql(
        """SELECT s.order_status, CAST(last + 7 AS DATE) AS week,
                  round(sum(order_total) FILTER (w = last), 2) AS revenue_lag_1, round(coalesce(sum(order_total) FILTER (w = last - 21), 0), 2) AS revenue_lag_4
           FROM (SELECT *, max(w) OVER (PARTITION BY order_status) AS last FROM (
                 SELECT order_status, order_total, CAST(date_trunc('week', purchase_date) AS DATE) + 6 AS w FROM shop_orders WHERE order_total > 0) x) s
           GROUP BY 1, 2""", "shop_orders")
    out["odd_weeks"] = _sql(
        f"SELECT week, order_count, review_count, round(avg_review_score, 4) AS avg_review_score FROM ({_weekly.replace('__ORDERS__', 'shop_orders')}) w "
        "WHERE order_count = 0 AND avg_review_score IS NOT NULL", "order_reviews", "shop_orders")

    out["ambiguous_sample"] = _sql(
        "SELECT review_id, text, text_length FROM reviews WHERE is_ambiguous "
        "ORDER BY md5(review_id::VARCHAR || ':42'), review_id LIMIT 5", "reviews")

    # --- evaluation ---
    # A split cuts each label's hashes at ranks that follow from the label's size alone.
    sizes = "SELECT stars, count(*) AS n FROM reviews GROUP BY stars"
    out["stratified_split"] = _sql(
        "SELECT stars, is_test, CASE WHEN is_test THEN cut ELSE n - cut END AS count FROM "
        f"(SELECT *, round((n - 1) * 0.2)::BIGINT AS cut FROM ({sizes}) s) c, (VALUES (true), (false)) v(is_test)", "reviews")
    out["stratified_folds"] = _sql(
        "SELECT stars, fold, (CASE WHEN fold = 4 THEN n ELSE round((n - 1) * (fold + 1) / 5.0)::BIGINT END) "
        "- (CASE WHEN fold = 0 THEN 0 ELSE round((n - 1) * fold / 5.0)::BIGINT END) AS count "
        f"FROM ({sizes}) s, (SELECT range::INT AS fold FROM range(5)) f", "reviews")
    out["eval_confusion"] = _sql(
        "SELECT quality AS label, CASE WHEN label = 'negative' THEN 0 ELSE 1 END AS prediction, count(*) AS count "
        "FROM (SELECT review_id AS doc_id, label AS label FROM polarity) p JOIN labels USING (doc_id) GROUP BY 1, 2",
        "polarity", texts="SELECT doc_id AS review_id, text FROM documents")
    out["eval_metrics"] = _sql(
        _metrics_by("language", "judged"), "polarity", texts=TEXTS_REVIEWS,
        judged=f"SELECT t.language, {_stars_label('t.stars')} AS label, p.label AS prediction FROM texts t JOIN polarity p USING (review_id)")
    return out
