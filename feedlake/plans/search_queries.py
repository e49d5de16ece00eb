"""Q1-Q27 over the views, for a fixed set of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.staging import staged
from feedlake.operators import search as q
from feedlake.operators.reports import build_vocab, known_brands
from feedlake.plans.normalize_queries import _SIZED
from feedlake.plans.report_queries import stops
from feedlake.plans.views import frame, with_views

TEXTS = ((1, "red plate"), (2, "hot"), (3, "blue widget under 950"), (4, '"small ring"'), (5, "plaet"), (6, "large damen sale"), (7, "old ring 900 - 1000 eur"))


def products(s, d):
    p = frame(s, d, "products")
    return p.withColumns({"price": F.col("price") / 100, "original_price": F.col("original_price") / 100})


def asked(s):
    sort = F.when(F.col("query_id") == 2, "price_asc").when(F.col("query_id") == 4, "discount").when(F.col("query_id") == 7, "newest")
    colours = F.when(F.col("query_id") == 1, F.array(F.lit("red"), F.lit("black")))
    category = F.when(F.col("query_id") == 2, F.array(F.lit("catalog > promo")))
    return s.createDataFrame(list(TEXTS), "query_id int, text string").withColumns({"sort": sort, "q_colour": colours, "q_category": category})


def plan(s, d):
    return q.prepare(asked(s), q.default_synonyms(s), known_brands(products(s, d)))


def _documents(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _tokens(s, d):
    return _documents(s, d).transform(q.tokenize).select("query_id", F.explode("tokens").alias("token"))


def _matched(s, d):
    return q.match_fulltext(plan(s, d), products(s, d))


def _candidates(s, d):
    return q.candidates(plan(s, d), products(s, d), fallback=False)


def _scored(s, d):
    return q.score(q.filter_products(_candidates(s, d)))


#: What rank, the variants and a page read of a row; the other columns aren't laid down and sorted with it.
_RANKED_BY = ("query_id", "feed_id", "external_id", "product_name", "colour", "price", "original_price", "last_updated", "sort", "score")


def _placed(s, d):
    return q.rank(_scored(s, d).select(*_RANKED_BY))


def _gendered(s, d):
    text = F.concat("search_text", F.when(F.col("feed_id") % 3 == 0, " herren").otherwise(" x"))
    # read twice by the gender filter
    return q.filter_gender(staged(_candidates(s, d).select("query_id", "feed_id", "external_id", text.alias("search_text"), "male", "female")))


def _searched(s, d):
    return q.search(asked(s), products(s, d), q.default_synonyms(s), known_brands(products(s, d)), 40)


def _smart(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("red shoe 10 - "), (i % 90 + 1).cast("string"), F.lit(" eur"))).when(i % 4 == 1, F.concat(F.lit("hat unter "), (i % 70).cast("string"))).when(
        i % 4 == 2, F.concat(F.lit("coat ab "), (i % 60).cast("string"), F.lit(" sale now"))).otherwise("plain words")
    return q.parse_queries(e.select(i.alias("query_id"), text.alias("text"))).select("query_id", "query", F.col("min_price").cast("long").alias("min_price"), F.col("max_price").cast("long").alias("max_price"), F.col("on_sale").cast("int").alias("on_sale"))


def _phrases(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('shoe "Air  Max '), F.col("event_id"), F.lit('" "one" x'))).otherwise("no phrase").alias("query"))
    return q.extract_phrases(e).withColumn("phrases", F.array_join("phrases", "|"))


def _parts(s, d):
    """Rows of parts whose id is divisible by 20, with the two words of their names."""
    word = lambda k: F.split("p_name", " ")[k]
    return s.read.parquet(f"{d}/part.parquet").where(F.col("p_partkey") % 20 == 0).select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), word(0).alias("a"), word(1).alias("b"))


def _plan_of(s, d, text):
    return q.prepare(_parts(s, d).select("query_id", F.expr(text).alias("text")), q.default_synonyms(s), known_brands(products(s, d)))


#: Names, names with a gender word for two in three, and pieces from inside the words of names.
_NAMES = "name"
_GENDERED = "name || CASE query_id % 60 WHEN 0 THEN ' damen' WHEN 20 THEN ' herren' ELSE '' END"
_PIECES = "substring(a, 2, 5) || ' ' || substring(b, 2, 5)"


def _lost(s, d):
    plan = _plan_of(s, d, _PIECES)
    return q.match_like(plan, products(s, d), q.matched_queries(plan, products(s, d)))


def _expanded(s, d):
    asked_for = _parts(s, d).select("query_id", F.expr(_GENDERED).alias("text"))
    found = q.expand(q.tokenize(q.extract_phrases(q.parse_queries(asked_for))), q.default_synonyms(s), known_brands(products(s, d)))
    return found.select("query_id", "pos", "token", "stemmed", F.array_join(F.array_sort("forms"), "|").alias("forms"), F.array_join("synonyms", "|").alias("synonyms"))


def _roles(s, d):
    return _plan_of(s, d, _GENDERED).select("query_id", *[F.col(c).cast("int").alias(c) for c in ("male", "female", "gendered")], F.size("scoring").alias("scoring"))


def _typos(s, d):
    """Every part's name with a slip in each word: two letters swapped, one left out, or one put in."""
    i = F.col("p_partkey") % 3
    slip = lambda w: F.when(i == 0, F.concat(F.substring(w, 1, 2), F.substring(w, 4, 1), F.substring(w, 3, 1), F.substring(w, 5, 99))).when(
        i == 1, F.concat(F.substring(w, 1, 3), F.substring(w, 5, 99))).otherwise(F.concat(F.substring(w, 1, 2), F.lit("x"), F.substring(w, 3, 99)))
    parts = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("query_id"), F.transform(F.split("p_name", " "), slip).alias("tokens"))
    return q.did_you_mean(parts, build_vocab(products(s, d), stops(s)))


#: What the simple search reads of a row; the other columns aren't shuffled with it.
_SIMPLE = ("feed_id", "external_id", "product_name", "brand", "category", "feed_name", "colour", "status")


def _simple(s, d, asked_for):
    return q.search_simple(asked_for, frame(s, d, "products").select(*_SIMPLE)).select("query_id", "feed_id", "external_id")


QUERIES = {
    "q1_parse_queries": _smart,
    "q2_extract_phrases": _phrases,
    "q3_tokenize": lambda s, d: _tokens(s, d).groupBy("query_id", "token").agg(F.count("*").alias("n")),
    "q4_stem": lambda s, d: _tokens(s, d).select("token", q.stem(F.col("token")).alias("stemmed")).distinct(),
    "q5_umlauts": lambda s, d: _tokens(s, d).select("token", q.fold_umlauts(F.col("token")).alias("folded"), q.unfold_umlauts(F.col("token")).alias("unfolded")).distinct(),
    "q6_expand": _expanded,
    "q7_split_gender": _roles,
    "q8_match_names": lambda s, d: q.match_fulltext(_plan_of(s, d, _NAMES), products(s, d)).select("query_id", "feed_id", "external_id"),
    "q8_match_fulltext": lambda s, d: _matched(s, d).select("query_id", "feed_id", "external_id"),
    "q11_filter_products": lambda s, d: q.filter_products(_candidates(s, d)).select("query_id", "feed_id", "external_id"),
    "q12_match_like": lambda s, d: _lost(s, d).select("query_id", "feed_id", "external_id"),
    "q13_filter_gender": lambda s, d: _gendered(s, d).select("query_id", "feed_id", "external_id"),
    "q15_score": lambda s, d: _scored(s, d).select("query_id", "feed_id", "external_id", "score"),
    "q17_rank": lambda s, d: _placed(s, d).select("query_id", "feed_id", "external_id", "place"),
    "q18_dedup_variants": lambda s, d: q.dedup_variants(_placed(s, d)).select("query_id", "feed_id", "external_id", "place"),
    "q19_page": lambda s, d: q.page(q.dedup_variants(_placed(s, d)), 10, 5).select("query_id", "feed_id", "external_id", "place"),
    "q20_totals": lambda s, d: q.totals(q.filter_products(_candidates(s, d))),
    "q21_facets": lambda s, d: q.facets(_candidates(s, d)),
    "q23_did_you_mean": _typos,
    "q24_search": lambda s, d: _searched(s, d).select("query_id", "place", "feed_id", "external_id", "score", "tier"),
    "q26_search_weighted": lambda s, d: q.search_weighted(plan(s, d), products(s, d)),
    "q25_search_simple": lambda s, d: _simple(s, d, asked(s)),
    "q25_search_pieces": lambda s, d: _simple(s, d, _parts(s, d).select("query_id", F.substring("name", 2, 7).alias("text"))),
}

#: The same queries taken apart by hand: groups of prefixes, short forms, phrases, filters.
_PLAN = {
    1: {"groups": (("plate", "plat"),), "shorts": (("red", "rot"),), "tokens": (("red", ("red",), ("rot",)), ("plate", ("plate", "plat"), ())), "extra": "lower(colour) IN ('red', 'black')"},
    2: {"groups": (), "shorts": (("hot",),), "tokens": (("hot", ("hot",), ()),), "extra": "lower(coalesce(category, '')) = 'catalog > promo' OR lower(coalesce(category, '')) LIKE 'catalog > promo > %'"},
    3: {"groups": (("blue", "blau"), ("widget",)), "shorts": (), "tokens": (("blue", ("blue", "blu"), ("blau",)), ("widget", ("widget",), ())), "extra": "price <= 95000"},
    4: {"groups": (("small",), ("ring",)), "shorts": (), "phrase": "small ring", "tokens": (("small", ("small",), ()), ("ring", ("ring",), ())), "extra": "true"},
    5: {"groups": (("plaet",),), "shorts": (), "tokens": (("plaet", ("plaet",), ()),), "extra": "true"},
    6: {"groups": (("large", "larg"),), "shorts": (), "tokens": (("large", ("large", "larg"), ()),), "extra": "original_price > price AND price > 0", "female": True},
    7: {"groups": (("ring",),), "shorts": (("old",),), "tokens": (("old", ("old",), ()), ("ring", ("ring",), ())), "extra": "price >= 90000 AND price <= 100000"},
}
_LOW = {n: f"lower(coalesce({n}, ''))" for n, _, _ in q.FIELDS}
_TEXT = "lower(concat_ws(' ', nullif(product_name, ''), nullif(brand, ''), nullif(feed_name, ''), nullif(category, ''), nullif(colour, '')))"


def _sql_word(field, form, full):
    return f"(CASE WHEN regexp_matches({_LOW[field]}, '(^|[^a-z0-9]){form}([^a-z0-9]|$)') THEN {full} WHEN contains({_LOW[field]}, '{form}') THEN {int(0.3 * full + 0.5)} ELSE 0 END)"


def _sql_points(forms, synonyms):
    direct = [f"nullif({' + '.join(_sql_word(n, f, full) for n, full, _ in q.FIELDS)}, 0)" for f in forms]
    other = []
    for f in synonyms:
        other += [f"nullif({_sql_word(n, f, weak)}, 0)" for n, _, weak in q.FIELDS[:3]]
        other.append(f"CASE WHEN {_sql_word('category', f, 10)} > 0 OR {_sql_word('feed_name', f, 10)} > 0 THEN 1 END")
    return f"coalesce({', '.join(direct + other)}, 0)"


def _sql_score(p):
    points = [_sql_points(forms, syns) for _, forms, syns in p["tokens"]]
    n = len(points)
    found = " + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in points)
    ratio = f"(({found}) / {n}.0)"
    base = f"CASE WHEN {ratio} = 1 THEN 10000 WHEN {ratio} >= 0.75 THEN 500 WHEN {ratio} >= 0.5 THEN 100 ELSE 10 END"
    named = " AND ".join("(" + " OR ".join(f"contains({_LOW['product_name']}, '{f}')" for f in (*forms, *syns)) + ")" for _, forms, syns in p["tokens"])
    brand = " OR ".join(f"regexp_matches({_LOW['brand']}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t, _, _ in p["tokens"])
    female = "(CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in q.FEMALE_TERMS) + " THEN 500 ELSE 0 END)" if p.get("female") else "0"
    phrase = f"(CASE WHEN contains({_LOW['product_name']}, '{p['phrase']}') THEN 5000 ELSE 0 END) + (CASE WHEN contains({_LOW['brand']}, '{p['phrase']}') THEN 2500 ELSE 0 END)" if "phrase" in p else "0"
    return f"({base}) + {' + '.join(points)} + (CASE WHEN {named if n > 1 else 'false'} THEN 50 ELSE 0 END) + (CASE WHEN {brand} THEN 20 ELSE 0 END) + {female} + {phrase}"


def _sql_match(p):
    tests = [f"regexp_matches(t, '(^|[^a-z0-9])({'|'.join(g)})')" for g in p["groups"]]
    tests += ["(" + " OR ".join(f"contains(t, '{f}')" for f in forms) + ")" for forms in p["shorts"]]
    return " AND ".join(tests + ([f"contains(t, '{p['phrase']}')"] if "phrase" in p else []))


_MATCH = f"rows AS (SELECT *, {_TEXT} AS t FROM products),\nm AS (" + " UNION ALL ".join(
    f"SELECT {k} AS query_id, ({p['extra']}) AS ok, {_sql_score(p)} AS score, * FROM rows WHERE {_sql_match(p)}" for k, p in _PLAN.items()
) + ")"
_OPEN = f"{_MATCH}, c AS (SELECT * FROM m WHERE status = 'active')"
_FILTERED = f"{_OPEN}, f AS (SELECT * FROM c WHERE ok)"
_OFF = "CASE WHEN original_price > price AND price > 0 THEN (original_price / 100.0::DOUBLE - price / 100.0::DOUBLE) / (original_price / 100.0::DOUBLE) ELSE 0 END"
_ORDER = f"""CASE WHEN query_id = 2 THEN price END ASC NULLS LAST, CASE WHEN query_id = 4 THEN {_OFF} END DESC NULLS LAST, CASE WHEN query_id = 7 THEN last_updated END DESC NULLS LAST, score DESC, external_id, feed_id"""
_VARIANT = f"lower(trim(regexp_replace(regexp_replace(coalesce(product_name, ''), {_SIZED}, ''), '(?i)\\s+[A-Z]\\d{{2,4}}\\s*$', ''))), lower(trim(coalesce(colour, '')))"
_RANKED = f"{_FILTERED}, r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}))::INT AS place FROM f)"
_DEDUP = f"{_RANKED}, v AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, {_VARIANT} ORDER BY place) = 1)"
_PAGED = "SELECT query_id, feed_id, external_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY place))::INT AS place FROM v"
_FACETS = " UNION ALL ".join(
    f"""(SELECT query_id, '{n}' AS dimension, value, n FROM (SELECT query_id, value, count(*) AS n FROM (SELECT DISTINCT query_id, lower({n}) AS value, {_VARIANT} FROM c
    WHERE (ok{f" OR query_id = {k}" if k else ""}) AND coalesce({n}, '') NOT IN ('', '0')) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, value) <= 50)"""
    for n, k in (("brand", 0), ("colour", 1), ("category", 2))
)
#: Q26 by hand: the tokens as they are asked for, with synonyms of one word.
_WEIGHTED = [(k, t, w, w == t) for k, tokens in {1: ("red", "plate"), 2: ("hot",), 3: ("blue", "widget"), 4: ("small", "ring"), 5: ("plaet",), 6: ("large", "damen"), 7: ("old", "ring")}.items()
             for t in tokens for w in sorted({t, *(x for g in q.SYNONYM_SETS if t in g for x in g)})]
_SQL_WEIGHTED = f"""asked(query_id, token, word, own) AS (VALUES {', '.join(f"({k}, '{t}', '{w}', {str(o).lower()})" for k, t, w, o in _WEIGHTED)}),
  n AS (SELECT query_id, count(DISTINCT token) AS n FROM asked GROUP BY query_id),
  f AS (SELECT feed_id, external_id, unnest(['product_name', 'brand', 'colour', 'category', 'feed_name']) AS field,
    unnest([coalesce(product_name, ''), coalesce(brand, ''), coalesce(colour, ''), coalesce(category, ''), coalesce(feed_name, '')]) AS value FROM products WHERE status = 'active'),
  h AS (SELECT query_id, feed_id, external_id, token, max((field = 'product_name' AND own)::INT) AS a, max((field = 'brand' AND own)::INT) AS b, max((field = 'product_name' AND NOT own)::INT) AS c
    FROM f JOIN asked ON regexp_matches(lower(value), '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)') GROUP BY ALL),
  g AS (SELECT query_id, feed_id, external_id, n, sum(a) AS a, sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS b, sum(CASE WHEN a = 0 AND b = 0 THEN c ELSE 0 END) AS c
    FROM h JOIN n USING (query_id) GROUP BY ALL HAVING count(*) = n),
  p AS (SELECT query_id, feed_id, external_id, (CASE WHEN a = n THEN 1000 WHEN a + c = n THEN 800 WHEN a > 0 AND b > 0 THEN 600 WHEN a + c > 0 THEN 400 ELSE 200 END + a * 100 + b * 75 + c * 50 + 100)::BIGINT AS points FROM g)"""
_SQL_TOKENS = """t AS (SELECT doc_id AS query_id, lower(trim(text)) AS x FROM documents),
  e AS (SELECT query_id, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM t),
  k AS (SELECT query_id, w, list_filter(w, lambda v: NOT list_contains([%s], v)) AS s FROM e),
  tokens AS (SELECT query_id, unnest(CASE WHEN len(s) > 0 THEN s ELSE w END) AS token FROM k)""" % ", ".join(f"'{w}'" for w in q.STOP_WORDS)
_STEM = "CASE " + " ".join(f"WHEN token LIKE '%{x}' AND length(token) - {len(x)} >= {3 if x == 'e' else 4} THEN left(token, length(token) - {len(x)})" for x in q.SUFFIXES) + " ELSE token END"


def _replaced(pairs):
    out = "token"
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


#: Queries of parts: tokens with their stems, forms (token, stem, synonyms) and whether they are long.
_PAIRS = "syn(token, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for g in q.SYNONYM_SETS for a in g for b in g if a != b) + ")"
_ASKED = f"""asked AS (SELECT p_partkey AS query_id, %s AS text FROM part WHERE p_partkey % 20 = 0),
  split AS (SELECT query_id, unnest(string_split(text, ' ')) AS token, unnest(generate_series(0, len(string_split(text, ' ')) - 1))::INT AS pos FROM asked),
  tok AS (SELECT query_id, pos, token, {_STEM} AS stemmed FROM split)"""
_ASKED = _ASKED.replace("p_partkey % 20", "p_partkey %% 20").replace("LIKE '%", "LIKE '%%")
_SQL_GENDERED = "p_name || CASE p_partkey % 60 WHEN 0 THEN ' damen' WHEN 20 THEN ' herren' ELSE '' END"
_SQL_PIECES = "substr(split_part(p_name, ' ', 1), 2, 5) || ' ' || substr(split_part(p_name, ' ', 2), 2, 5)"
#: Rows where every token is met: a long one by a word's beginning, a short one as a substring. Queries of one text share its rows.
_MET = f"""{_PAIRS}, rows AS (SELECT feed_id, external_id, {_TEXT} AS t FROM products), texts AS (SELECT text, min(query_id) AS one FROM asked GROUP BY text),
  form AS (SELECT query_id, pos, length(token) >= 4 AS long, token AS form FROM tok UNION SELECT query_id, pos, length(token) >= 4, stemmed FROM tok
    UNION SELECT query_id, pos, length(tok.token) >= 4, synonym FROM tok JOIN syn ON syn.token IN (tok.token, tok.stemmed)),
  near AS (SELECT DISTINCT one, pos, long, form FROM form JOIN texts ON one = query_id WHERE NOT long OR length(form) >= 4),
  hit AS (SELECT one, feed_id, external_id, pos FROM near JOIN rows ON CASE WHEN long THEN regexp_matches(t, '(^|[^a-z0-9])' || form) ELSE contains(t, form) END GROUP BY ALL),
  met AS (SELECT one, feed_id, external_id FROM hit GROUP BY ALL HAVING count(DISTINCT pos) = 2)"""

ORACLE_SQL = {
    "q1_parse_queries": """SELECT event_id AS query_id, CASE event_id % 4 WHEN 0 THEN 'red shoe' WHEN 1 THEN 'hat' WHEN 2 THEN 'coat now' ELSE 'plain words' END AS query,
      CASE event_id % 4 WHEN 0 THEN least(10, event_id % 90 + 1) WHEN 2 THEN event_id % 60 END AS min_price,
      CASE event_id % 4 WHEN 0 THEN greatest(10, event_id % 90 + 1) WHEN 1 THEN event_id % 70 END AS max_price, (event_id % 4 = 2)::INT AS on_sale FROM events""",
    "q2_extract_phrases": """SELECT event_id AS query_id, CASE WHEN event_id % 2 = 0 THEN 'shoe x' ELSE 'no phrase' END AS query, CASE WHEN event_id % 2 = 0 THEN 'air max ' || event_id ELSE '' END AS phrases FROM events""",
    "q3_tokenize": f"WITH {_SQL_TOKENS} SELECT query_id, token, count(*) AS n FROM tokens GROUP BY ALL",
    "q4_stem": f"WITH {_SQL_TOKENS} SELECT DISTINCT token, {_STEM} AS stemmed FROM tokens",
    "q5_umlauts": f"WITH {_SQL_TOKENS} SELECT DISTINCT token, {_replaced(q.UMLAUTS)} AS folded, {_replaced((b, a) for a, b in q.UMLAUTS)} AS unfolded FROM tokens",
    "q6_expand": f"""WITH {_ASKED % _SQL_GENDERED}, {_PAIRS},
      forms AS (SELECT *, list_sort(list_distinct([token, stemmed, {_replaced(q.UMLAUTS)}, {_replaced(q.UMLAUTS).replace("token", "stemmed")}, {_replaced((b, a) for a, b in q.UMLAUTS)}, {_replaced((b, a) for a, b in q.UMLAUTS).replace("token", "stemmed")}])) AS forms FROM tok),
      found AS (SELECT query_id, pos, list_sort(list(DISTINCT synonym)) AS l FROM forms f JOIN syn ON list_contains(f.forms, syn.token) AND synonym <> f.token GROUP BY ALL)
      SELECT f.query_id, f.pos, token, stemmed, array_to_string(forms, '|') AS forms, coalesce(array_to_string(l, '|'), '') AS synonyms FROM forms f LEFT JOIN found USING (query_id, pos)""",
    "q7_split_gender": """SELECT p_partkey AS query_id, (p_partkey % 60 = 20)::INT AS male, (p_partkey % 60 = 0)::INT AS female, (p_partkey % 60 IN (0, 20))::INT AS gendered, 2 AS scoring
      FROM part WHERE p_partkey % 20 = 0""",
    "q8_match_names": with_views(f"WITH {_ASKED % 'p_name'}, {_MET} SELECT query_id, feed_id, external_id FROM asked JOIN texts USING (text) JOIN met USING (one)", "products"),
    "q12_match_like": with_views(
        f"""WITH {_ASKED % _SQL_PIECES}, {_MET}, lost AS (SELECT * FROM texts WHERE one NOT IN (SELECT one FROM met)),
        sub AS (SELECT one, feed_id, external_id, pos FROM (SELECT DISTINCT one, pos, form FROM form JOIN lost ON one = query_id) JOIN rows ON contains(t, form) GROUP BY ALL)
        SELECT query_id, feed_id, external_id FROM asked JOIN lost USING (text) JOIN (SELECT one, feed_id, external_id FROM sub GROUP BY ALL HAVING count(DISTINCT pos) = 2) USING (one)""", "products"),
    "q23_did_you_mean": with_views(
        """WITH a AS (SELECT * FROM products WHERE status = 'active'), b AS (SELECT DISTINCT lower(trim(brand)) AS token FROM a WHERE length(lower(trim(brand))) >= 3),
        w AS (SELECT unnest(regexp_split_to_array(lower(product_name), '[^\\p{L}\\p{N}]+')) AS token FROM a),
        e AS (SELECT token, 100 AS freq FROM b UNION ALL SELECT token, count(*) FROM w WHERE length(token) >= 4 AND token NOT IN ('with', 'from') GROUP BY token),
        vocab AS (SELECT token AS word, sum(freq)::BIGINT AS freq FROM e GROUP BY token HAVING sum(freq) >= 3),
        s AS (SELECT p_partkey, unnest([1, 2]) AS pos, split_part(p_name, ' ', unnest([1, 2])) AS w FROM part),
        t AS (SELECT p_partkey, pos, CASE p_partkey % 3 WHEN 0 THEN substr(w, 1, 2) || substr(w, 4, 1) || substr(w, 3, 1) || substr(w, 5) WHEN 1 THEN substr(w, 1, 3) || substr(w, 5) ELSE substr(w, 1, 2) || 'x' || substr(w, 3) END AS token FROM s),
        u AS (SELECT DISTINCT token FROM t WHERE length(token) >= 4 AND token NOT IN (SELECT word FROM vocab)),
        n AS (SELECT token, word FROM (SELECT token, word, freq, damerau_levenshtein(token, word) AS d FROM u JOIN vocab ON abs(length(token) - length(word)) <= 2)
          WHERE d <= least(2, length(token) // 4) QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, freq DESC, word) = 1)
        SELECT p_partkey AS query_id, CASE WHEN count(word) > 0 THEN string_agg(coalesce(word, t.token), ' ' ORDER BY pos) END AS suggestion FROM t LEFT JOIN n ON n.token = t.token GROUP BY p_partkey""", "products"),
    "q25_search_pieces": with_views(
        """WITH a AS (SELECT p_partkey AS query_id, substr(p_name, 2, 7) AS text FROM part WHERE p_partkey % 20 = 0), d AS (SELECT DISTINCT text FROM a),
        h AS (SELECT d.text, p.* FROM products p JOIN d ON p.status = 'active' AND (contains(lower(coalesce(product_name, '')), text) OR contains(lower(coalesce(brand, '')), text) OR contains(lower(coalesce(category, '')), text) OR contains(lower(coalesce(feed_name, '')), text))),
        k AS (SELECT text, feed_id, external_id FROM h WHERE colour = '' UNION ALL SELECT text, feed_id, external_id FROM (SELECT * FROM h WHERE colour <> '' QUALIFY row_number() OVER (PARTITION BY text, product_name, colour ORDER BY external_id, feed_id) = 1))
        SELECT query_id, feed_id, external_id FROM a JOIN k USING (text)""", "products"),
    "q8_match_fulltext": with_views(f"WITH {_MATCH} SELECT query_id, feed_id, external_id FROM m", "products"),
    "q11_filter_products": with_views(f"WITH {_FILTERED} SELECT query_id, feed_id, external_id FROM f", "products"),
    "q13_filter_gender": with_views(f"WITH {_OPEN} SELECT query_id, feed_id, external_id FROM c WHERE query_id <> 6 OR feed_id % 3 <> 0", "products"),
    "q15_score": with_views(f"WITH {_FILTERED} SELECT query_id, feed_id, external_id, score::INT AS score FROM f", "products"),
    "q17_rank": with_views(f"WITH {_RANKED} SELECT query_id, feed_id, external_id, place FROM r", "products"),
    "q18_dedup_variants": with_views(f"WITH {_DEDUP} SELECT query_id, feed_id, external_id, place FROM v", "products"),
    "q19_page": with_views(f"WITH {_DEDUP} SELECT query_id, feed_id, external_id, place FROM ({_PAGED}) WHERE place > 5 AND place <= 15", "products"),
    "q20_totals": with_views(f"WITH {_FILTERED} SELECT query_id, count(*) AS total FROM (SELECT DISTINCT query_id, {_VARIANT} FROM f) GROUP BY query_id", "products"),
    "q21_facets": with_views(
        f"""WITH {_OPEN} {_FACETS} UNION ALL SELECT query_id, 'price', 'min', (min(price) // 100)::BIGINT FROM c WHERE ok AND price > 0 GROUP BY query_id
        UNION ALL SELECT query_id, 'price', 'max', (max(price) // 100)::BIGINT FROM c WHERE ok AND price > 0 GROUP BY query_id""", "products"),
    "q24_search": with_views(
        f"""WITH {_DEDUP} SELECT query_id, place, feed_id, external_id, score::INT AS score, CASE WHEN score >= 10000 THEN 'T1' WHEN score >= 500 THEN 'T2' WHEN score >= 100 THEN 'T3' ELSE 'T4' END AS tier
        FROM ({_PAGED}) WHERE place <= 40""", "products"),
    "q26_search_weighted": with_views(
        f"WITH {_SQL_WEIGHTED} SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY points DESC, external_id, feed_id))::INT AS place FROM p) WHERE place <= 50", "products"),
    "q25_search_simple": with_views(
        """WITH a(query_id, text) AS (VALUES (1, 'red plate'), (2, 'hot'), (3, 'blue widget under 950'), (4, '"small ring"'), (5, 'plaet'), (6, 'large damen sale'), (7, 'old ring 900 - 1000 eur')),
        h AS (SELECT a.query_id, p.* FROM products p JOIN a ON p.status = 'active' AND (contains(lower(coalesce(product_name, '')), text) OR contains(lower(coalesce(brand, '')), text) OR contains(lower(coalesce(category, '')), text) OR contains(lower(coalesce(feed_name, '')), text)))
        SELECT query_id, feed_id, external_id FROM h WHERE colour = '' UNION ALL SELECT query_id, feed_id, external_id FROM (SELECT * FROM h WHERE colour <> '' QUALIFY row_number() OVER (PARTITION BY query_id, product_name, colour ORDER BY external_id, feed_id) = 1)""", "products"),
}
