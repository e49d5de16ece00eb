"""Search as a batch relevance job (Q1-Q27): a table of queries against the product table.

``prepare`` turns the queries into one row each with its groups, short words, phrases and filters;
matching enters every query by its rarest part through inverted lists, so the query side stays a table and
is never looped over. Products need feed_id, external_id,
product_name, brand, feed_name, category, colour, price, original_price, in_stock, status,
last_updated; search text is taken from the ``search_text`` column or made from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.values import non_empty
from feedlake.functions.staging import staged
from feedlake.operators.normalize import search_text, strip_size
from feedlake.operators.postings import bounded, dealt, drive, few, fits_in, holding, limited, met
from feedlake.operators.reports import ACTIVE
from feedlake.operators.spelling import near_words

#: Words for men and boys, and for women and girls.
MALE_TERMS = ("man", "men", "herren", "mann", "männer", "herr", "male", "gentleman", "gentlemen", "boys", "boy", "junge", "jungen")
FEMALE_TERMS = ("women", "damen", "frau", "frauen", "woman", "dame", "female", "lady", "ladies", "girls", "girl", "mädchen")
#: Suffixes taken off a token, in this order, one at most.
SUFFIXES = ("isches", "ische", "ischer", "ischen", "ischem", "iges", "iger", "igem", "igen", "ige", "em", "en", "er", "es", "e")
#: Folding of umlauts.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Words that a query loses, German and English.
STOP_WORDS = tuple(
    "der die das den dem des ein eine einer eines einem einen und oder aber mit für fur von vom zum zur auf aus bei bis nach vor seit"
    " in im an am um ist sind hat haben wird werden nicht kein keine keinen keiner ich du er sie es wir ihr mein dein sein unser euer"
    " auch noch schon sehr nur mal dann denn doch dort hier jetzt kann mehr muss nun ob weil wenn wie wo über ueber unter zwischen gegen"
    " ohne während the a and or but with for from of to at by on is are was were has have had be been being not no nor i you he she it we"
    " they my your his her its our their this that these those some any all each every very just also so too into about than then there"
    " here where when what which who how can could would should will shall may might must need more most much many few less only own other"
    " another such like get got make made".split()
)
#: Fixed values in the first four sets (words for women, men, girls and boys): synonym sets that come with the package; more are
#: passed as a table (token, synonym).
SYNONYM_SETS = (
    ("women", "woman", "damen", "frau", "frauen", "dame", "female", "lady", "ladies"),
    ("men", "man", "herren", "mann", "männer", "herr", "male", "gentleman", "gentlemen"),
    ("girls", "girl", "mädchen"), ("boys", "boy", "junge", "jungen"), ("red", "rot"), ("blue", "blau"), ("heel", "heels", "pumps"), ("slide", "slides", "badelatschen"),
)
#: How prices and sales are put in a query, German and English.
_UNIT = r"\s*(?:€|eur|euro|\$|usd|gbp|£)?\b"
RANGE = rf"(?i)(\d{{1,5}})\s*(?:-|–|—|to|bis)\s*(\d{{1,5}}){_UNIT}"
MOST = rf"(?i)(?:^|\s)(?:unter|under|max\.?|bis|<=?)\s*(\d{{1,5}}){_UNIT}"
LEAST = rf"(?i)(?:^|\s)(?:ab|from|over|mindestens|min\.?|>=?)\s*(\d{{1,5}}){_UNIT}"
SALE = r"(?i)(?:^|\s)(?:im\s+sale|on\s+sale|sale|reduziert|im\s+angebot|angebot|discount)(?=\s|$)"
PREFIX = 4
FACET_SIZE = 50
PKEY = ["feed_id", "external_id"]


def default_synonyms(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for group in SYNONYM_SETS for a in group for b in group if a != b], "token string, synonym string")


def parse_queries(q: DataFrame) -> DataFrame:
    """Q1: price range, bounds and sale words out of ``text`` into min_price, max_price and on_sale."""
    q = q.withColumn("_t", F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")))

    def cut(frame: DataFrame, pattern: str, names: tuple[str, ...]) -> DataFrame:
        for i, name in enumerate(names):
            frame = frame.withColumn(name, F.nullif(F.regexp_extract("_t", pattern, i + 1), F.lit("")).try_cast("double"))
        hit = F.regexp_extract("_t", pattern, 0)
        return frame.withColumn("_t", F.when(hit != "", F.replace("_t", hit, F.lit(" "))).otherwise(F.col("_t")))

    q = cut(cut(cut(q, RANGE, ("_a", "_b")), MOST, ("_most",)), LEAST, ("_least",))
    sale = F.col("_t").rlike(SALE)
    parsed = {
        "min_price": F.greatest(F.least("_a", "_b"), F.col("_least")), "max_price": F.least(F.greatest("_a", "_b"), F.col("_most")), "on_sale": sale,
        "query": F.trim(F.regexp_replace(F.regexp_replace("_t", SALE, " "), r"\s+", " ")),
    }
    given = {n: F.coalesce(F.col(n), parsed[n]) if n != "on_sale" else F.coalesce(F.col(n), F.lit(False)) | sale for n in ("min_price", "max_price", "on_sale") if n in q.columns}
    return q.withColumns(parsed | given).drop("_t", "_a", "_b", "_most", "_least")


def extract_phrases(q: DataFrame) -> DataFrame:
    """Q2: quoted phrases of two words or more into ``phrases``; the rest stays in ``query``."""
    found = F.transform(F.regexp_extract_all("query", F.lit('"([^"]{2,})"'), F.lit(1)), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))))
    rest = F.trim(F.regexp_replace(F.regexp_replace("query", '"[^"]*"', " "), r"\s+", " "))
    q = q.withColumn("phrases", F.filter(found, lambda p: p.contains(" ")))
    return q.withColumn("query", F.when(F.size("phrases") == 0, F.col("query")).when(rest == "", F.array_join("phrases", " ")).otherwise(rest))


def tokenize(q: DataFrame) -> DataFrame:
    """Q3: ``tokens``: lower case, split on space, without stop words unless all are."""
    every = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda t: t != "")
    kept = F.filter(every, lambda t: ~t.isin(*STOP_WORDS))
    return q.withColumn("tokens", F.when(F.size(kept) > 0, kept).otherwise(every))


def stem(token: Column) -> Column:
    """Q4: one suffix off; at least 4 characters stay (3 for 'e')."""
    longer = "|".join(s for s in SUFFIXES if s != "e")
    # the shortest beginning of 4 characters is the longest suffix; one pattern keeps the plan small where stems are used often
    return F.regexp_replace(token, rf"(?s)^(?:(.{{4,}}?)(?:{longer})|(.{{3,}})e)\z", "$1$2")


def fold_umlauts(token: Column) -> Column:
    """Q5: ä, ö, ü and ß written out."""
    for umlaut, plain in UMLAUTS:
        token = F.replace(token, F.lit(umlaut), F.lit(plain))
    return token


def unfold_umlauts(token: Column) -> Column:
    """Q5, the other way."""
    for umlaut, plain in UMLAUTS:
        token = F.replace(token, F.lit(plain), F.lit(umlaut))
    return token


def expand(q: DataFrame, synonyms: DataFrame, brands: DataFrame) -> DataFrame:
    """Q6: (query_id, pos, token, stemmed, forms, synonyms): brands are not stemmed; synonyms of
    every form of a token but the token itself. brands: brand, lower case.
    """
    tokens = q.select("query_id", F.posexplode("tokens").alias("pos", "token"))
    known = brands.select(F.col("brand").alias("token"), F.lit(True).alias("_brand")).distinct()
    tokens = tokens.join(known, "token", "left").withColumn("stemmed", F.when(F.col("_brand"), F.col("token")).otherwise(stem(F.col("token")))).drop("_brand")
    both = F.array("token", "stemmed")
    forms = F.array_distinct(F.concat(both, F.transform(both, fold_umlauts), F.transform(both, unfold_umlauts)))
    tokens = tokens.withColumn("forms", forms)
    pairs = tokens.select("query_id", "pos", F.col("token").alias("_own"), F.explode("forms").alias("token")).join(synonyms.select("token", "synonym"), "token")
    found = pairs.where(F.col("synonym") != F.col("_own")).groupBy("query_id", "pos").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))
    return tokens.join(found, ["query_id", "pos"], "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))


def split_gender(expanded: DataFrame) -> DataFrame:
    """Q7: one row per query: scoring tokens (gender words only if there are no others), and
    whether it asks for male, female or both; ``gendered``: gender words apply as a bonus.
    """
    is_male, is_female = F.col("token").isin(*MALE_TERMS), F.col("token").isin(*FEMALE_TERMS)
    row = F.struct("pos", "token", "stemmed", "synonyms", (is_male | is_female).alias("gender"))
    per = expanded.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("t"), F.max(is_male).alias("male"), F.max(is_female).alias("female"))
    plain = F.filter("t", lambda x: ~x["gender"])
    return per.select("query_id", "male", "female", F.col("t").alias("every"), F.when(F.size(plain) > 0, plain).otherwise(F.col("t")).alias("scoring"), ((F.size(plain) > 0) & (F.col("male") | F.col("female"))).alias("gendered"))


def _bare(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, r'[+\-><()~*"@]', ""))


def prepare(queries: DataFrame, synonyms: DataFrame, brands: DataFrame) -> DataFrame:
    """Q1-Q7 in a row: the queries with query, phrases, tokens, scoring, groups and shorts.

    groups: for each token of 4 characters or more the prefixes of which one must occur; shorts:
    for each shorter token the forms of which one must occur.
    """
    parsed = tokenize(extract_phrases(parse_queries(queries)))
    roles = split_gender(expand(parsed, synonyms, brands))
    long = lambda x: F.length(_bare(x["token"])) >= PREFIX
    parts = lambda x: F.filter(F.array_distinct(F.transform(F.concat(F.array(x["token"], x["stemmed"]), x["synonyms"]), _bare)), lambda p: F.length(p) >= PREFIX)
    forms = lambda x: F.filter(F.array_distinct(F.transform(F.concat(F.array(x["token"]), x["synonyms"]), _bare)), lambda p: p != "")
    groups = F.transform(F.filter("scoring", long), lambda x: F.struct(x["pos"].alias("pos"), parts(x).alias("parts")))
    shorts = F.transform(F.filter("scoring", lambda x: ~long(x) & (_bare(x["token"]) != "")), lambda x: forms(x))
    # matching, scoring and facets all read it
    return staged(parsed.join(roles, "query_id", "left").withColumn("groups", groups).withColumn("shorts", shorts))


def with_text(products: DataFrame) -> DataFrame:
    made = search_text(products)
    return products.withColumn("search_text", F.lower(F.coalesce(non_empty(F.col("search_text")), made) if "search_text" in products.columns else made))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def has_form(text: Column, form: Column) -> Column:
    """A short form: a number as a whole word, letters as a substring."""
    return F.when(form.rlike(r"^\d+$"), F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), form, F.lit(" ")))).otherwise(text.contains(form))


def _texts(rows: DataFrame) -> DataFrame:
    """Keys and search texts, staged: matching reads them several times, and the other columns once."""
    return staged(rows.select(*PKEY, "search_text"))


def _shared(queries: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(the distinct values of the columns, with the smallest query_id that has them; all queries as (one, query_id)).
    Queries that ask for the same are looked for once.
    """
    some = queries.select("query_id", *names)
    ones = staged(some.groupBy(*names).agg(F.min("query_id").alias("query_id")))
    one = bounded(ones.select(F.col("query_id").alias("one"), *names))
    return ones, some.join(one, list(names)).select("one", "query_id")


def _fulltext_keys(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, key) that may meet Q8-Q10, by inverted lists. rows: ``_texts`` of the products."""
    # words are looked up by the whole part they begin with, of the lengths that are asked for
    grouped = checks.select("query_id", F.explode("groups").alias("g")).select("query_id", F.col("g.pos").alias("group"), F.explode("g.parts").alias("form"))
    grouped = staged(grouped.withColumn("terms", F.array("form")))
    terms = grouped.select(F.col("form").alias("term")).distinct()
    lengths = F.array(*[F.lit(r[0]) for r in terms.select(F.length("term")).distinct().collect()]).cast("array<int>")
    beginnings = lambda w: F.transform(F.filter(lengths, lambda n: F.length(w) >= n), lambda n: F.substring(w, F.lit(1), n))
    long = F.filter(F.array_distinct(words_of(F.col("search_text"))), lambda w: F.length(w) >= PREFIX)
    postings = rows.select(*PKEY, F.explode(F.array_distinct(F.flatten(F.transform(long, beginnings)))).alias("term"))
    found = drive(grouped, limited(postings, terms), PKEY)
    # queries of short words and phrases alone are entered by their grams
    bare = checks.where((F.size("groups") == 0) & ((F.size("shorts") > 0) | (F.size("phrases") > 0)))
    parts = F.concat(F.col("shorts"), F.transform("phrases", lambda p: F.array(p)))
    forms = bare.select("query_id", F.posexplode(parts).alias("group", "f")).select("query_id", "group", F.explode("f").alias("form"))
    return found.unionByName(holding(forms, rows, PKEY, "search_text"))


def _longest(groups: Column) -> Column:
    """Of arrays of terms the one whose shortest term is the longest: a long term is met by fewer rows."""
    sized = F.transform(groups, lambda g: F.struct(F.array_min(F.transform(g, lambda f: F.length(f))).alias("n"), F.array_distinct(g).alias("terms")))
    return F.array_max(sized)["terms"]


def _fulltext_rows(plan: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of Q8-Q10 with the query_id of the first query that asks so, all queries as (one, query_id)). rows: ``with_text``."""
    checks, members = _shared(plan, "groups", "shorts", "phrases")
    text, spaced = F.col("search_text"), F.col("_spaced")
    # a word begins with a part where the part stands behind a space, once all between words is a space
    begins = lambda p: ~p.contains(" ") & spaced.contains(F.concat(F.lit(" "), p))
    whole = F.forall("groups", lambda g: F.exists(g["parts"], begins))
    fits = whole & F.forall("shorts", lambda fs: F.exists(fs, lambda f: has_form(text, f))) & F.forall("phrases", lambda p: text.contains(p))
    with_spaces = lambda frame: frame.withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    # words are looked for behind the spaces of the text, short words and phrases anywhere
    begun = F.transform(_longest(F.transform("groups", lambda g: g["parts"])), lambda t: F.concat(F.lit(" "), t))
    anywhere = F.transform(_longest(F.concat(F.col("shorts"), F.transform("phrases", lambda p: F.array(p)))), lambda t: F.concat(F.lit("="), t))
    entries = staged(checks.withColumn("terms", F.when(F.size("groups") > 0, begun).otherwise(anywhere)).where(F.size("terms") > 0))
    listed = few(entries.select(F.explode("terms").alias("term")).distinct())
    if listed is not None and fits_in(entries):
        tests = {t: spaced.contains(F.lit(t)) if t[0] == " " else text.contains(F.lit(t[1:])) for t in listed}
        found = met(with_spaces(rows), entries, tests)
    else:
        texts = _texts(rows)
        keys = _fulltext_keys(checks, texts).distinct().join(with_spaces(texts), PKEY)
        keys = keys.join(bounded(checks), "query_id").where(fits).select("query_id", *PKEY)
        return keys.join(rows, PKEY).select("query_id", *rows.columns), members
    return found.where(fits).select("query_id", *rows.columns), members


def match_fulltext(plan: DataFrame, products: DataFrame) -> DataFrame:
    """Q8-Q10: (query_id, product columns) where every group has a word with one of its prefixes,
    every short token one of its forms, and every phrase occurs. Queries that ask for the same are matched once; with
    few terms the rows meet the queries where they are read, with more a query is entered by its rarest group.
    """
    return dealt(*_fulltext_rows(plan, with_text(products)), PKEY)


def matched_queries(plan: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id) of the queries that ``match_fulltext`` finds rows for."""
    return _found_for(*_fulltext_rows(plan, with_text(products)))


def _found_for(found: DataFrame, members: DataFrame) -> DataFrame:
    ones = staged(found.select(F.col("query_id").alias("one")).distinct())
    return members.join(bounded(ones), "one").select("query_id").distinct()


def _like_rows(plan: DataFrame, rows: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of Q12 with the query_id of the first query that asks so, all its queries as (one, query_id))."""
    lost = plan.join(matched.select("query_id").distinct(), "query_id", "left_anti").where(F.size("scoring") > 0).select("query_id", "scoring")
    forms = lambda x: F.array_distinct(F.concat(F.array(x["token"], x["stemmed"]), x["synonyms"]))
    lost, members = _shared(lost.select("query_id", F.transform("scoring", forms).alias("_groups")), "_groups")
    text = F.col("search_text")
    fits = F.forall("_groups", lambda g: F.exists(g, lambda f: text.contains(f)))
    entries = staged(lost.withColumn("terms", _longest(F.col("_groups"))))
    listed = few(entries.select(F.explode("terms").alias("term")).distinct())
    if listed is not None and fits_in(entries):
        return met(rows, entries, {t: text.contains(F.lit(t)) for t in listed}).where(fits).select("query_id", *rows.columns), members
    asked = lost.select("query_id", F.posexplode("_groups").alias("group", "f")).select("query_id", "group", F.explode("f").alias("form"))
    texts = _texts(rows)
    near = holding(asked, texts, PKEY, "search_text").join(texts, PKEY)
    keys = near.join(bounded(lost), "query_id").where(fits).select("query_id", *PKEY)
    return keys.join(rows, PKEY).select("query_id", *rows.columns), members


def match_like(plan: DataFrame, products: DataFrame, matched: DataFrame) -> DataFrame:
    """Q12: for queries without a match, rows whose text holds a form of every token as a substring. matched: query_id of
    those that have one. With many terms the forms' grams lead to the rows; a query is entered by its rarest token.
    """
    return dealt(*_like_rows(plan, with_text(products), matched), PKEY)


def _tests(listed_by: tuple[str, ...] = ("brand", "colour", "category")) -> tuple[dict[str, Column], Column]:
    """Whether a row passes the filter of each listed dimension, and all other filters and being active."""
    listed = lambda name, wanted: F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.array_contains(wanted, F.lower(F.coalesce(F.col(name), F.lit(""))))
    path = F.lower(F.coalesce(F.col("category"), F.lit("")))
    subtree = F.coalesce(F.size("q_category") <= 0, F.lit(True)) | F.exists("q_category", lambda c: (path == c) | path.startswith(F.concat(c, F.lit(" > "))))
    low = ~(F.coalesce("min_price", F.lit(0.0)) > 0) | (F.col("price") >= F.col("min_price"))
    high = ~(F.coalesce("max_price", F.lit(0.0)) > 0) | (F.col("price") <= F.col("max_price"))
    sale = ~F.coalesce("on_sale", F.lit(False)) | ((F.col("original_price") > F.col("price")) & (F.col("price") > 0))
    stock = ~F.coalesce("q_in_stock", F.lit(False)) | (F.col("in_stock") == 1)
    by = {"brand": listed("brand", F.col("q_brand")), "colour": listed("colour", F.col("q_colour")), "category": subtree}
    return {n: by[n] for n in listed_by}, (F.col("status") == ACTIVE) & low & high & sale & stock


def filter_products(rows: DataFrame) -> DataFrame:
    """Q11: rows that pass their query's filters (columns q_brand, q_colour, q_category as arrays of
    lower-case values or null; min_price, max_price, on_sale, q_in_stock) and are active.
    """
    by, rest = _tests()
    return rows.where(rest & by["brand"] & by["colour"] & by["category"])


def _says(terms: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words_of(F.col("search_text")), F.array(*[F.lit(t) for t in terms]))


def _wrong_gender(male: Column, female: Column) -> Column:
    """Whether a row that names men or women names only the gender that its query doesn't ask for."""
    wrong = F.when(F.col("male") & ~F.col("female"), female & ~male).when(F.col("female") & ~F.col("male"), male & ~female).otherwise(False)
    return F.coalesce(wrong, F.lit(False))


def filter_gender(cands: DataFrame) -> DataFrame:
    """Q13: rows that name only the other gender go; if that leaves a query without rows, none go."""
    marked = cands.withColumn("_ok", ~_wrong_gender(_says(MALE_TERMS), _says(FEMALE_TERMS)))
    # only the queries without a fitting row meet the rows
    none = marked.groupBy("query_id").agg(F.max("_ok").alias("_some")).where(~F.col("_some"))
    return marked.join(F.broadcast(none), "query_id", "left").where(F.col("_ok") | F.col("_some").isNotNull()).drop("_ok", "_some")


def word_match(words: Column, text: Column, form: Column, full: int) -> Column:
    """Q14 with its points: full for a whole word, round(0.3 * full) for a substring, else 0."""
    return F.when(F.array_contains(words, form), full).when(text.contains(form), int(0.3 * full + 0.5)).otherwise(0)


FIELDS = (("product_name", 10, 5), ("brand", 5, 3), ("colour", 3, 2), ("category", 2, 1), ("feed_name", 2, 1))


def score(cands: DataFrame) -> DataFrame:
    """Q15, Q16: ``score`` of each candidate (with scoring, phrases, male, female, gendered)."""
    low = {n: F.lower(F.coalesce(F.col(n), F.lit(""))) for n, _, _ in FIELDS}
    cands = cands.withColumns({f"_{n}": t for n, t in low.items()} | {f"_w_{n}": words_of(F.col(n)) for n in low})
    field = lambda n, form, points: word_match(F.col(f"_w_{n}"), F.col(f"_{n}"), form, points)

    def direct(form: Column) -> Column:
        return sum((field(n, form, full) for n, full, _ in FIELDS), F.lit(0))

    def by_synonym(form: Column) -> Column:
        named = [F.when(field(n, form, 10) > 0, field(n, form, weak)) for n, _, weak in FIELDS[:3]]
        rest = F.when((field("category", form, 10) > 0) | (field("feed_name", form, 10) > 0), 1)
        return F.coalesce(*named, rest, F.lit(0))

    def points(x: Column) -> Column:
        forms = F.array_distinct(F.array(x["token"], x["stemmed"], fold_umlauts(x["token"])))
        own = F.filter(F.transform(forms, direct), lambda p: p > 0)
        other = F.filter(F.transform(x["synonyms"], by_synonym), lambda p: p > 0)
        in_name = F.exists(F.concat(forms, x["synonyms"]), lambda f: field("product_name", f, 10) > 0)
        in_brand = F.array_contains(F.col("_w_brand"), x["token"])
        return F.struct(F.coalesce(F.get(own, F.lit(0)), F.get(other, F.lit(0)), F.lit(0)).alias("points"), in_name.alias("in_name"), in_brand.alias("in_brand"))

    scored = cands.withColumn("_s", F.transform("scoring", points))
    n = F.size("_s")
    found = F.size(F.filter("_s", lambda x: x["points"] > 0))
    total = F.aggregate("_s", F.lit(0), lambda a, x: a + x["points"])
    base = F.when(found == n, 10000).when(found / n >= 0.75, 500).when(found / n >= 0.5, 100).otherwise(10)
    both = F.concat(F.col("_product_name"), F.lit(" "), F.col("search_text"))
    names = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: both.contains(t))
    bonus = (
        F.when(F.forall("_s", lambda x: x["in_name"]) & (n > 1), 50).otherwise(0)
        + F.when(F.exists("_s", lambda x: x["in_brand"]), 20).otherwise(0)
        + F.when(F.col("gendered") & F.col("female") & names(FEMALE_TERMS), 500).otherwise(0)
        + F.when(F.col("gendered") & F.col("male") & names(MALE_TERMS), 500).otherwise(0)
    )
    phrased = F.aggregate(
        "phrases", F.lit(0), lambda a, p: a + F.when(F.col("_product_name").contains(p), 5000).otherwise(0) + F.when(F.col("_brand").contains(p), 2500).otherwise(0)
    )
    drop = [f"_{n}" for n in low] + [f"_w_{n}" for n in low] + ["_s"]
    return scored.withColumn("score", F.when(n > 0, base + total + bonus).otherwise(0) + phrased).drop(*drop)


#: Rows of all queries that ``rank`` orders in one range; more rows are dealt to more ranges.
ROWS_A_RANGE = 100_000


def _discount_share() -> Column:
    return F.when((F.col("original_price") > F.col("price")) & (F.col("price") > 0), (F.col("original_price") - F.col("price")) / F.col("original_price")).otherwise(0.0)


def sort_key() -> Column:
    """The order of ``rank`` as one value, smallest first; a missing price or date comes last."""
    sort = F.coalesce(F.col("sort"), F.lit("relevance"))
    down = lambda c: F.nanvl(-c.cast("double"), F.lit(float("-inf")))
    keys = {"price_asc": F.col("price").cast("double"), "price_desc": down(F.col("price")), "discount": down(_discount_share())}
    by = [F.when(sort == name, value) for name, value in keys.items()] + [F.when(sort == "newest", -F.unix_micros(F.col("last_updated").cast("timestamp")))]
    parts = [x for i, value in enumerate(by) for x in (value.isNull().alias(f"none_{i}"), value.alias(f"by_{i}"))]
    return F.struct(*parts, (-F.col("score")).alias("score"), F.col("external_id"), F.col("feed_id"))


def rank(cands: DataFrame) -> DataFrame:
    """Q17: ``place`` in each query by its sort (relevance, price_asc, price_desc, discount, newest),
    then score, external_id and feed_id. No task holds more of a query than a range of its rows.
    """
    sort = F.coalesce(F.col("sort"), F.lit("relevance"))
    off = _discount_share()
    keys = [
        F.when(sort == "price_asc", F.col("price")).asc_nulls_last(), F.when(sort == "price_desc", F.col("price")).desc_nulls_last(),
        F.when(sort == "discount", off).desc_nulls_last(), F.when(sort == "newest", F.col("last_updated")).desc_nulls_last(),
    ]
    order = [*keys, F.desc("score"), F.asc("external_id"), F.asc("feed_id")]
    # sampled split points deal the rows into ranges of the whole order; a place is the rows in ranges before it, and those in its own
    # sampling reads the rows as well as dealing does, so they are laid down first
    cands = staged(cands)
    ranges = cands.count() // ROWS_A_RANGE + 1
    dealt = staged(cands.repartitionByRange(ranges, F.asc("query_id"), *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("query_id", "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("query_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("query_id", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("query_id", "_range").orderBy(*order))
    # as many tasks as ranges: left to the sizes of shuffles, a task would take more of them the larger the table is
    dealt = dealt.repartition(ranges, "query_id", "_range")
    return dealt.withColumn("_own", own).join(starts, ["query_id", "_range"]).withColumn("place", (F.col("_start") + F.col("_own")).cast("int")).drop("_start", "_own", "_range")


def variant_key() -> list[Column]:
    return [F.lower(strip_size(F.coalesce(F.col("product_name"), F.lit("")))), F.lower(F.trim(F.coalesce(F.col("colour"), F.lit(""))))]


def dedup_variants(ranked: DataFrame) -> DataFrame:
    """Q18: the first of each (size-stripped name, colour) in rank order; no colour is one key."""
    return first_variants(ranked, "place")


def first_variants(rows: DataFrame, by: str) -> DataFrame:
    name, colour = variant_key()
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy("query_id", name.alias("_name"), colour.alias("_colour")).agg(F.min_by(row, by).alias("_row"))
    return best.select("_row.*")


def page(ranked: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q19: places offset + 1 to offset + limit of each query, counted anew. The first of parts are taken before those of the whole."""
    part = F.pmod("place", F.lit(64))
    few = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", part).orderBy("place"))).where(F.col("_k") <= offset + limit).drop("_k")
    window = Window.partitionBy("query_id").orderBy("place")
    return few.withColumn("place", F.row_number().over(window)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def totals(matches: DataFrame) -> DataFrame:
    """Q20: distinct variants of each query's matches, before the gender filter."""
    name, colour = variant_key()
    return matches.select("query_id", name.alias("n"), colour.alias("c")).distinct().groupBy("query_id").agg(F.count("*").alias("total"))


def facets(rows: DataFrame, top: int = FACET_SIZE) -> DataFrame:
    """Q21, Q22: values of brand, colour and category with their variant counts, each without its
    own filter, the ``top`` of each; and the price range with all filters (dimension price).
    """
    names = ("brand", "colour", "category")
    passes, rest = _tests(names)
    base, colour = F.col("_base"), F.col("_shade")
    entry = lambda n, value, b, c, price: F.struct(F.lit(n).alias("dimension"), value.alias("value"), b.alias("b"), c.alias("c"), price.cast("double").alias("price"))
    none = F.lit(None).cast("string")
    made = []
    for name in names:
        others = [passes[n] for n in names if n != name]
        made.append(F.when(others[0] & others[1] & non_empty(F.col(name)).isNotNull(), entry(name, F.lower(F.col(name)), base, colour, F.lit(None))))
    made.append(F.when(passes["brand"] & passes["colour"] & passes["category"] & (F.col("price") > 0), entry("price", none, none, none, F.col("price"))))
    # one scan: each row says to which dimensions it counts, each without its own filter
    keyed = rows.where(rest).withColumns(dict(zip(("_base", "_shade"), variant_key())))
    entries = keyed.select("query_id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("query_id", "x.*")
    variants = entries.groupBy("query_id", "dimension", "value", "b", "c").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    counted = variants.groupBy("query_id", "dimension", "value").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    window = Window.partitionBy("query_id", "dimension").orderBy(F.desc("n"), "value")
    best = counted.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= top)
    value = lambda v, n: F.struct(v.alias("value"), n.cast("long").alias("n"))
    listed = F.when(F.col("dimension") == "price", F.array(value(F.lit("min"), F.col("lo")), value(F.lit("max"), F.col("hi")))).otherwise(F.array(value(F.col("value"), F.col("n"))))
    return best.select("query_id", "dimension", F.explode(listed).alias("x")).select("query_id", "dimension", "x.value", "x.n")


def did_you_mean(q: DataFrame, vocab: DataFrame) -> DataFrame:
    """Q23: (query_id, suggestion): each unknown token of 4 characters or more replaced by the
    nearest vocabulary word within min(2, length / 4) edits; null where nothing changes.
    """
    tokens = q.select("query_id", F.posexplode("tokens").alias("pos", "token"))
    unknown = tokens.where(F.length("token") >= 4).join(vocab.select("token"), "token", "left_anti").select("token").distinct()
    unknown = unknown.withColumn("most", F.least(F.lit(2), F.floor(F.length("token") / 4)).cast("int"))
    close = near_words(unknown, vocab.select(F.col("token").alias("word"), "freq"))
    best = close.groupBy("token").agg(F.min(F.struct("d", (-F.col("freq")).alias("f"), "word"))["word"].alias("word"))
    fixed = tokens.join(best, "token", "left").withColumn("changed", F.col("word").isNotNull())
    row = F.struct("pos", F.coalesce("word", "token").alias("w"))
    per = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.max("changed").alias("changed"))
    return per.select("query_id", F.when(F.col("changed"), F.array_join(F.transform("r", lambda x: x["w"]), " ")).alias("suggestion"))


def candidates(plan: DataFrame, products: DataFrame, fallback: bool = True) -> DataFrame:
    """Matches with their query's columns, filtered (Q8-Q12)."""
    rows = with_text(products.where(F.col("status") == ACTIVE))
    wanted = plan.select("query_id", "scoring", "phrases", "male", "female", "gendered", "min_price", "max_price", "on_sale", *[c for c in plan.columns if c.startswith("q_") or c == "sort"])
    for name, kind in (("q_brand", "array<string>"), ("q_colour", "array<string>"), ("q_category", "array<string>"), ("q_in_stock", "boolean"), ("sort", "string")):
        if name not in wanted.columns:
            wanted = wanted.withColumn(name, F.lit(None).cast(kind))
    with_columns = lambda found, members: dealt(found, members.join(wanted, "query_id"), PKEY)
    found, members = _fulltext_rows(plan, rows)
    if fallback:
        found = staged(found)  # read for the rows, and for the queries that have some
    matched = with_columns(found, members)
    if fallback:
        lost = with_columns(*_like_rows(plan, rows, staged(_found_for(found, members))))
        matched = matched.unionByName(lost)
    return matched


def search(queries: DataFrame, products: DataFrame, synonyms: DataFrame, brands: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q24: query_id, place, product columns, score and tier, exact (no candidate cap)."""
    # read twice by the gender filter, and for the rows that are shown
    found = staged(filter_products(candidates(prepare(queries, synonyms, brands), products)).withColumn("_row_id", F.monotonically_increasing_id()))
    scored = score(filter_gender(found)).withColumn("_key", sort_key()).select("query_id", "_row_id", "product_name", "colour", "score", "_key")
    # the first of each variant, then the first of each query: places of rows that no page shows are never counted, and of
    # the rows no more than what orders them is sorted
    best = first_variants(scored, "_key").drop("product_name", "colour")
    part = F.pmod(F.xxhash64("_row_id"), F.lit(64))
    few_rows = best.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", part).orderBy("_key"))).where(F.col("_k") <= offset + limit).drop("_k")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_key"))
    shown = few_rows.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("_row_id", "place", "score")
    shown = found.join(bounded(staged(shown)), "_row_id").drop("_row_id")
    return shown.withColumn("tier", tier(F.col("score")))


def search_simple(q: DataFrame, products: DataFrame) -> DataFrame:
    """Q25: substring in name, brand, category or feed name; of each (name, colour) the smallest
    (external_id, feed_id), rows without colour all kept.
    """
    fields = ("product_name", "brand", "category", "feed_name")
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    rows = products.where(F.col("status") == ACTIVE).withColumn("_text", F.concat_ws("\n", *low))
    asked, members = _shared(q.where(F.col("text").isNotNull()).select("query_id", F.lower("text").alias("form")), "form")
    listed = few(asked.select(F.col("form").alias("term")))
    if listed is not None:
        near = met(rows, asked.withColumn("terms", F.array("form")), {t: F.col("_text").contains(F.lit(t)) for t in listed})
    else:
        near = holding(asked.withColumn("group", F.lit(0)), rows, PKEY, "_text").join(bounded(asked), "query_id").join(rows, PKEY)
    hit = near.where(F.exists(F.array(*low), lambda t: t.contains(F.col("form")))).select("query_id", *products.columns, F.col("form").alias("text"))
    plain = non_empty(F.col("colour")).isNull()
    # the first of a (name, colour) is an aggregate; rows without colour are groups of their own
    own = F.when(plain, F.struct(*PKEY))
    row = F.struct(*[F.col(f"`{c}`") for c in hit.columns])
    best = hit.groupBy("query_id", F.when(~plain, F.col("product_name")).alias("_name"), F.when(~plain, F.col("colour")).alias("_colour"), own.alias("_own")).agg(
        F.min_by(row, F.struct("external_id", "feed_id")).alias("_row")
    )
    return dealt(best.select("_row.*"), members, PKEY)


#: Points of Q26 by where all tokens are found, and for each token.
ALL_IN_NAME, ALL_WITH_SYNONYMS, NAME_AND_BRAND, SOME_IN_NAME, ELSEWHERE = 1000, 800, 600, 400, 200
PER_NAME, PER_BRAND, PER_SYNONYM, PER_DESCRIPTION = 100, 75, 50, 10


def search_weighted(plan: DataFrame, products: DataFrame, limit: int = 50) -> DataFrame:
    """Q26: query_id, place, feed_id, external_id and points: every token, or a synonym of one word, must be a whole
    word of some field. A token counts once: in the name, else in the brand, else as a synonym in the name, else
    elsewhere. Rows that name only the other gender go.

    Product words meet the words asked for in one join, so queries are never looped over.
    """
    rows = with_text(products.where(F.col("status") == ACTIVE))
    wanted = plan.select("query_id", F.size(F.array_distinct("tokens")).alias("_n"), "male", "female", F.explode(F.array_distinct("tokens")).alias("token"))
    synonyms = plan.select("query_id", F.explode("every").alias("x")).select("query_id", F.col("x.token").alias("token"), F.explode("x.synonyms").alias("word")).distinct()
    asked = wanted.select("query_id", "_n", "male", "female", "token", F.col("token").alias("word"), F.lit(True).alias("_own")).unionByName(
        wanted.join(synonyms, ["query_id", "token"]).select("query_id", "_n", "male", "female", "token", "word", F.lit(False).alias("_own"))
    )
    asked = bounded(staged(asked))  # words of queries are few keys, of which each would be one task
    fields = [f for f in ("product_name", "brand", "colour", "category", "feed_name", "description") if f in products.columns]
    of = lambda f: F.transform(F.array_distinct(words_of(F.col(f))), lambda w: F.struct(F.lit(f).alias("field"), w.alias("word")))
    words = F.flatten(F.array(*[of(f) for f in fields]))
    rows = rows.select(*PKEY, _says(MALE_TERMS).alias("_men"), _says(FEMALE_TERMS).alias("_women"), F.explode(words).alias("w"))
    hits = rows.select(*PKEY, "_men", "_women", "w.field", "w.word").join(asked, "word")
    query = ("_n", "male", "female", "_men", "_women")
    there = lambda field, own: F.max((F.col("field") == field) & (F.col("_own") == own))
    per = hits.groupBy("query_id", *PKEY, "token").agg(
        *[F.first(c).alias(c) for c in query], there("product_name", True).alias("a"),
        there("brand", True).alias("b"), there("product_name", False).alias("c"), F.max(F.col("field") == "description").alias("d"),
    )
    count = lambda c: F.count_if(c)
    a, b, c = F.col("a"), ~F.col("a") & F.col("b"), ~F.col("a") & ~F.col("b") & F.col("c")
    found = per.groupBy("query_id", *PKEY).agg(
        *[F.first(c).alias(c) for c in query], F.count("*").alias("_found"),
        count(a).alias("_a"), count(b).alias("_b"), count(c).alias("_c"), count(~a & ~b & ~c & F.col("d")).alias("_d"),
    ).where(F.col("_found") == F.col("_n"))
    found = found.where(~_wrong_gender(F.col("_men"), F.col("_women")))
    base = (
        F.when(F.col("_a") == F.col("_n"), ALL_IN_NAME).when(F.col("_a") + F.col("_c") == F.col("_n"), ALL_WITH_SYNONYMS)
        .when((F.col("_a") > 0) & (F.col("_b") > 0), NAME_AND_BRAND).when(F.col("_a") + F.col("_c") > 0, SOME_IN_NAME).otherwise(ELSEWHERE)
    )
    points = base + F.col("_a") * PER_NAME + F.col("_b") * PER_BRAND + F.col("_c") * PER_SYNONYM + F.col("_d") * PER_DESCRIPTION + 100
    scored = found.select("query_id", *PKEY, points.cast("long").alias("points"))
    # the best of parts first, so that no task sorts all rows of a common word
    part = F.pmod(F.xxhash64(*PKEY), F.lit(64))
    few = Window.partitionBy("query_id", part).orderBy(F.desc("points"), "external_id", "feed_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("points"), "external_id", "feed_id")
    best = scored.withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= limit).drop("_k")
    return best.withColumn("place", F.row_number().over(last)).where(F.col("place") <= limit)


def tier(s: Column) -> Column:
    """Q27: T1 to T4."""
    return F.when(s >= 10000, "T1").when(s >= 500, "T2").when(s >= 100, "T3").otherwise("T4")
