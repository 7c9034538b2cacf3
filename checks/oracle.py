"""The registered queries as plain SQL over the given tables, written independently of the library."""

import re

from placerank.config import (
    AMBIENCES, ATTRIBUTE_NAMES, ATTRIBUTES, COMPLIMENTS, DAYS, ORDINALS, PRICE, TRISTATES,
)

N = len(ATTRIBUTES)
LAT, LON = "27.948e0", "(-82.46e0)"


def pick(index, labels):
    whens = " ".join(f"WHEN {i} THEN '{str(v).replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(labels) if v is not None)
    return f"CASE {index} {whens} END"


def dist(lat1, lon1, lat2=LAT, lon2=LON):
    dlat = f"(radians({lat2} - CAST({lat1} AS DOUBLE)) / 2)"
    dlon = f"(radians({lon2} - CAST({lon1} AS DOUBLE)) / 2)"
    return (f"(asin(sqrt(least(sin({dlat}) * sin({dlat}) + cos(radians(CAST({lat1} AS DOUBLE))) * "
            f"cos(radians({lat2})) * (sin({dlon}) * sin({dlon})), 1e0))) * 2 * 6371.0e0)")


def _tristates():
    return ", ".join(
        f"CAST(NULL AS VARCHAR) AS raw_{a}" if a == "DogsAllowed"
        else pick(f"((k // {j + 1}) + {j}) % 4", ["True", "False", "None", None]) + f" AS raw_{a}"
        for j, a in enumerate(TRISTATES))


def _ambience():
    entries = " || ', ' || ".join(
        f"mark || '''{a}'': ' || CASE WHEN (k // {i + 3}) % 3 = 0 THEN 'True' ELSE 'False' END"
        for i, a in enumerate(AMBIENCES))
    return f"CASE (k // 5) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE '{{' || {entries} || '}}' END"


def _hours():
    return ", ".join(
        f"CASE (k + {d}) % 5 WHEN 1 THEN '0:0-0:0' WHEN 2 THEN '9:0-17:30' WHEN 3 THEN '18:0-2:0' "
        f"WHEN 4 THEN (k % 12) || ':' || (15 * (k % 4)) || '-' || (12 + k % 12) || ':0' END AS raw_{day}"
        for d, day in enumerate(DAYS))


def minutes(text, part):
    return (f"(TRY_CAST(regexp_extract({text}, '{part}', 1) AS INTEGER) * 60 + "
            f"TRY_CAST(regexp_extract({text}, '{part}', 2) AS INTEGER))")


def opens(text):
    return minutes(text, r"(\d+):(\d+)-")


def closes(text):
    return minutes(text, r"-(\d+):(\d+)")


def tristate(c):
    return f"CAST(CASE {c} WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS TINYINT)"


def stripped(c):
    return f"regexp_replace({c}, '^u?[''\"](.+)[''\"]$', '\\1')"


def ordinal(a, c):
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDINALS[a].items())
    return f"CAST(CASE {stripped(c)} {whens} END AS TINYINT)"


def flag(a, c="raw_Ambience"):
    return f"CAST(CASE WHEN contains(coalesce({c}, ''), '''{a}'': True') THEN 1 ELSE 0 END AS TINYINT)"


def ambience_value(a):
    return (f"CASE WHEN contains(raw_Ambience, '''{a}'': True') THEN 1 "
            f"WHEN contains(raw_Ambience, '''{a}'': False') THEN 0 END")


def attribute(a):
    if a in TRISTATES:
        return tristate(f"raw_{a}")
    if a in ORDINALS:
        return ordinal(a, f"raw_{a}")
    if a == PRICE:
        return f"TRY_CAST(raw_{a} AS TINYINT)"
    return flag(a.removeprefix("Ambience_"))


QUALITY = "round(log10(review_count + 1) * (CAST(stars AS DOUBLE) * CAST(stars AS DOUBLE)), 3)"


def total(term):
    return " + ".join(term(i) for i in range(N))


def means(prefix=""):
    return ", ".join(f"coalesce(avg({prefix}{a}), {float(d)}e0) AS m{i}" for i, (a, d, _) in enumerate(ATTRIBUTES))


def filled(attrs="b", means_from="m"):
    return ", ".join(f"coalesce(CAST({attrs}.{a} AS DOUBLE), {means_from}.m{i}) AS f{i}" for i, a in enumerate(ATTRIBUTE_NAMES))


LENGTH = f"sqrt(greatest({total(lambda i: f'f{i} * f{i}')}, 1e-300)) AS len"


def weighted_mean(weight):
    return ", ".join(
        f"CASE WHEN sum({weight}) > 0 THEN CAST(sum(CAST(floor(f{i} * ({weight} / len) * 1e12 + 0.5e0) AS BIGINT)) "
        f"AS DOUBLE) / (sum({weight}) * 1e12) END AS u{i}" for i in range(N))


SCORE = ("floor((" + total(lambda i: f"f{i} * (u{i} * {float(ATTRIBUTES[i][2])}e0)")
         + ") / len * 1e12 + 0.5e0) / 1e12")


def bin_ctes(scored, prefix="", by="query_id", value="similarity"):
    """Quantile bins in window form: ranks, interpolated edges, edges below a value."""
    p = prefix
    return {
        f"{p}ranked": f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {by}) AS pool FROM {scored}",
        f"{p}pools": f"SELECT DISTINCT {by}, pool, CAST(greatest(floor(sqrt(pool)), 1) AS BIGINT) AS bins FROM {p}ranked",
        f"{p}steps": f"SELECT {by}, pool, bins, unnest(generate_series(0, bins)) AS k FROM {p}pools",
        f"{p}positions": f"SELECT *, (pool - 1) * CASE WHEN k = bins THEN 1e0 ELSE k * (1e0 / bins) * 1e2 / 1e2 END AS v FROM {p}steps",
        f"{p}edges": f"""SELECT s.{by}, s.k, CASE WHEN s.v - floor(s.v) < 0.5e0
                THEN a.{value} + (b.{value} - a.{value}) * (s.v - floor(s.v))
                ELSE b.{value} - (b.{value} - a.{value}) * (1e0 - (s.v - floor(s.v))) END AS edge
            FROM {p}positions s
            JOIN {p}ranked a ON a.{by} = s.{by} AND a.rn = CAST(floor(s.v) AS BIGINT) + 1
            JOIN {p}ranked b ON b.{by} = s.{by} AND b.rn = least(CAST(floor(s.v) AS BIGINT) + 2, s.pool)""",
        f"{p}distinct_edges": f"SELECT DISTINCT {by}, edge FROM {p}edges",
        f"{p}binned": f"""SELECT r.*, greatest(coalesce((SELECT count(*) FROM {p}distinct_edges e
            WHERE e.{by} = r.{by} AND e.edge < r.{value}), 0), 1) - 1 AS similarity_bin FROM {p}ranked r""",
    }


CTES = {
    "business_raw": f"""SELECT k, 'b' || k AS business_id, p_name AS name, p_brand || ' ' || p_size AS address,
        'City' || (k % 20) AS city, 'S' || (k % 5) AS state, 27.5e0 + (37 * k % 1000) / 1e3 AS latitude,
        -83e0 + (91 * k % 1000) / 1e3 AS longitude, 1e0 + (7 * k % 9) / 2e0 AS stars,
        coalesce(c, 0) AS review_count, CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END AS is_open,
        CASE WHEN k % 50 = 0 THEN NULL ELSE replace(p_name, ' ', ', ') || ', ' || p_type END AS categories,
        {_tristates()},
        {pick("(k // 6) % 6", ["u'quiet'", "'average'", "loud", "u'very_loud'", "None"])} AS raw_NoiseLevel,
        {pick("(k // 25) % 5", ["u'casual'", "'dressy'", "formal", "None"])} AS raw_RestaurantsAttire,
        {pick("(k // 36) % 6", ["1", "2", "3", "4", "None"])} AS raw_RestaurantsPriceRange2,
        {_ambience()} AS raw_Ambience, {_hours()}
        FROM (SELECT p_partkey AS k, *, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE '' END AS mark FROM part)
        LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY l_partkey) ON k = l_partkey""",
    "business": f"""SELECT * EXCLUDE (categories), string_split(categories, ', ') AS categories, {QUALITY} AS quality,
        CASE WHEN sort_of_open = 1 THEN true ELSE false END AS open_flag FROM (
        SELECT k, business_id, name, address, city, state, CAST(latitude AS FLOAT) AS latitude,
        CAST(longitude AS FLOAT) AS longitude, CAST(stars AS FLOAT) AS stars, CAST(review_count AS INTEGER) AS review_count,
        is_open AS sort_of_open, categories,
        {", ".join(f"{attribute(a)} AS {a}" for a in ATTRIBUTE_NAMES)},
        {", ".join(f"{opens(f'raw_{d}')} AS {d}_open_mins, {closes(f'raw_{d}')} AS {d}_close_mins" for d in DAYS)}
        FROM business_raw WHERE categories IS NOT NULL)""",
    "review_raw": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS review_id,
        'u' || o_custkey AS user_id, 'b' || l_partkey AS business_id, 1e0 + ((l_quantity - 1) % 9) / 2e0 AS stars,
        CAST(l_linenumber AS BIGINT) AS useful, CAST(l_linenumber % 3 AS BIGINT) AS funny, CAST(l_linenumber % 2 AS BIGINT) AS cool,
        l_returnflag || l_linestatus AS text, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "user_raw": f"""SELECT k, 'u' || k AS user_id, c_name AS name, k % 100 AS review_count,
        CASE WHEN k % 97 = 0 THEN 'unknown' ELSE (2010 + k % 10) || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-' ||
        lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':00:00' END AS yelping_since,
        k % 50 AS useful, k % 30 AS funny, k % 20 AS cool, '' AS elite,
        'u' || (k + 1) || ', u' || (k + 2) || ', u' || (k + 3) AS friends, k % 7 AS fans, 1e0 + (k % 9) / 2e0 AS average_stars,
        {", ".join(f"{9 if c == 'cool' else i + 1} * k % 7 AS compliment_{c}" for i, c in enumerate(COMPLIMENTS))}
        FROM (SELECT c_custkey AS k, * FROM customer)""",
    "profiles": """SELECT * EXCLUDE (name), CASE WHEN k % 10 <> 0 THEN name END AS name,
        CASE WHEN k % 3 <> 0 THEN 27e0 + (k % 10) / 10e0 END AS latitude,
        CASE WHEN k % 3 <> 0 THEN -82e0 - (k % 10) / 10e0 END AS longitude FROM user_raw""",
    "tip_raw": """SELECT 'u' || user_id AS user_id, 'b' || user_id AS business_id, event_type AS text,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, CAST(floor(value) AS BIGINT) AS compliment_count FROM events""",
    "checkin_raw": """SELECT 'b' || event_id AS business_id, event_id, date_trunc('second', ts) AS t,
        strftime(ts, '%Y-%m-%d %H:%M:%S') || ',  ' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') ||
        CASE WHEN event_id % 2 = 1 THEN ', later' ELSE '' END AS date FROM events""",
    "latest": """SELECT user_id, business_id, stars AS user_stars FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, business_id ORDER BY date DESC, review_id DESC) AS rn FROM review_raw) WHERE rn = 1""",
    "queries": f"""SELECT k, 'q' || k AS query_id, CASE WHEN k % 10 = 0 THEN 'x' ELSE 'u' END || k AS user_id,
        CASE k % 3 WHEN 0 THEN 'radial' WHEN 1 THEN 'city' ELSE 'state' END AS mode,
        CASE WHEN k % 3 = 2 THEN 'S' || (k % 5) END AS state, CASE WHEN k % 3 = 1 THEN 'City' || (k % 20) END AS city,
        CASE WHEN k % 3 = 0 THEN 27.5e0 + (37 * k % 1000) / 1e3 END AS latitude,
        CASE WHEN k % 3 = 0 THEN -83e0 + (91 * k % 1000) / 1e3 END AS longitude,
        CASE WHEN k % 3 = 0 THEN 5e0 + 5e0 * (k % 4) END AS radius_km,
        CASE WHEN k % 2 = 0 THEN string_split(p_name, ' ') ELSE string_split(p_name, ' ')[1:1] END AS categories,
        CAST(k % 7 AS INTEGER) AS day, CAST(37 * k % 1440 AS INTEGER) AS minutes, k % 4 <> 0 AS open_now, k % 5 = 0 AS keep_reviewed,
        k % 6 = 0 AS trip, k % 2 = 0 AS detail
        FROM (SELECT c_custkey AS k FROM customer) JOIN part ON k = p_partkey""",
    "vocabulary": """SELECT word, count(*) AS n FROM (SELECT unnest(categories) AS word FROM business)
        GROUP BY word HAVING count(*) >= 10""",
    "word_vectors": "SELECT 'w' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "category_vectors": """SELECT word, CAST(embedding AS DOUBLE[]) AS v FROM vocabulary JOIN embeddings
        ON vec_id = CAST(CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings) AS BIGINT)""",
    "resolved": "SELECT *, list_sort(list_distinct(categories)) AS terms FROM queries",
    "day_hours": "SELECT business_id, " + ", ".join(
        ["[" + ", ".join(f"{d}_open_mins" for d in DAYS) + "] AS o", "[" + ", ".join(f"{d}_close_mins" for d in DAYS) + "] AS c"]) + " FROM business",
    "pool_means": f"""SELECT terms, {means('b.')} FROM (SELECT DISTINCT terms FROM resolved) t
        JOIN business b ON list_has_any(b.categories, t.terms) GROUP BY terms""",
    "history": """SELECT t.user_id, t.terms, l.user_stars, b.* FROM (SELECT DISTINCT user_id, terms FROM resolved) t
        JOIN latest l ON l.user_id = t.user_id JOIN business b ON b.business_id = l.business_id
        WHERE list_has_any(b.categories, t.terms)""",
    "history_means": f"SELECT user_id, terms, {means()} FROM history GROUP BY user_id, terms",
    "history_filled": f"SELECT b.user_id, b.terms, b.user_stars, {filled()} FROM history b JOIN history_means m ON m.user_id = b.user_id AND m.terms = b.terms",
    "history_vectors": f"SELECT *, {LENGTH} FROM history_filled",
    "own": f"SELECT user_id, terms, {weighted_mean('user_stars')} FROM history_vectors GROUP BY user_id, terms",
    "in_place": f"""SELECT q.query_id, b.* FROM resolved q JOIN business b ON b.open_flag AND list_has_any(b.categories, q.terms)
        AND ((q.mode = 'state' AND b.state = q.state) OR (q.mode = 'city' AND b.city = q.city)
        OR (q.mode = 'radial' AND {dist('b.latitude', 'b.longitude', 'q.latitude', 'q.longitude')} <= q.radius_km))""",
    "pool_filled": f"""SELECT q.query_id, q.user_id, q.terms, q.day, q.minutes, q.open_now, q.keep_reviewed, b.business_id, b.quality, {filled()}
        FROM in_place b JOIN resolved q ON q.query_id = b.query_id JOIN pool_means m ON m.terms = q.terms""",
    "pool": f"SELECT *, {LENGTH} FROM pool_filled",
    "neutral": f"SELECT query_id, {weighted_mean('1e0')} FROM pool GROUP BY query_id",
    "preference": "SELECT q.query_id, " + ", ".join(f"coalesce(o.u{i}, n.u{i}) AS u{i}" for i in range(N)) + """
        FROM resolved q LEFT JOIN own o ON o.user_id = q.user_id AND o.terms = q.terms LEFT JOIN neutral n ON n.query_id = q.query_id""",
    "rated": "SELECT user_id, business_id, user_stars FROM latest SEMI JOIN business USING (business_id)",
    "readable": """SELECT p.* FROM pool p JOIN day_hours h ON h.business_id = p.business_id WHERE
        (NOT p.open_now OR coalesce(h.o[p.day + 1] <= p.minutes AND (h.c[p.day + 1] > p.minutes OR h.c[p.day + 1] <= h.o[p.day + 1]), false)
         OR coalesce(h.c[(p.day + 6) % 7 + 1] <= h.o[(p.day + 6) % 7 + 1] AND h.c[(p.day + 6) % 7 + 1] > p.minutes, false))
        AND (p.keep_reviewed OR NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = p.user_id AND r.business_id = p.business_id))""",
    "scored": f"SELECT r.query_id, r.business_id, r.quality, {SCORE} AS similarity FROM readable r JOIN preference p ON p.query_id = r.query_id",
    **bin_ctes("scored"),
    "top": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_bin DESC, quality DESC NULLS LAST, business_id) AS rank FROM binned""",
}


def with_ctes(body, **extra):
    """`body` with the views it names, directly or through other views, put in front."""
    known = {**CTES, **extra}
    order, seen = [], set()

    def visit(text):
        for word in re.findall(r"[a-z_]+", text):
            if word in known and word not in seen:
                seen.add(word)
                if not re.search(rf"(FROM|JOIN)\s+{word}\b", text):
                    seen.discard(word)
                    continue
                visit(known[word])
                order.append(word)

    visit(body)
    ctes = ", ".join(f"{name} AS (\n{known[name]})" for name in order)
    return f"WITH {ctes}\n{body}" if ctes else body
