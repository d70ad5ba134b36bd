"""Queries over text functions, on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.functions import text as T
from corelog.operators.common import bounded
from corelog.registry import query, table

_MAT, _HARD = ["river", "stone", "Water", "land"], ["hard", "soft", "strong"]


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


_STRIP = r"""st AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '\b(?:Water|river|stone|land)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM documents),
st2 AS (SELECT doc_id, text, a, trim(regexp_replace(regexp_replace(a, '(?i)\b(?:strong|hard|soft)\b', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM st)"""


@query(f"WITH {_STRIP} SELECT doc_id, md5(a) AS material, md5(b) AS everything FROM st2")
def strip_vocabulary(s, d):
    """Material words, then strength words too, removed; shown by digests."""
    docs = _docs(s, d)
    return docs.select("doc_id", F.md5(T.strip_modes(F.col("text"), _MAT, _HARD, "lithology_only")).alias("material"), F.md5(T.strip_modes(F.col("text"), _MAT, _HARD, "full")).alias("everything"))


@query(f"""WITH {_STRIP} SELECT CAST(sum(length(coalesce(text, '')) - length(coalesce(b, ''))) AS BIGINT) AS chars_removed, CAST(sum(CASE WHEN text <> b THEN 1 ELSE 0 END) AS BIGINT) AS texts_changed,
CAST(sum(CASE WHEN length(trim(text)) > 0 AND length(trim(b)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS texts_emptied FROM st2""")
def strip_statistics(s, d):
    """What a strip removed, in one aggregation."""
    docs = _docs(s, d).withColumn("b", T.strip_modes(F.col("text"), _MAT, _HARD, "full"))
    return docs.agg(*T.removal_stats("text", "b"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '(\\n|[\s　])+', ' ', 'g'))) AS tidy FROM documents""")
def tidy_text(s, d):
    """X3's white space, as an expression."""
    return _docs(s, d).select("doc_id", F.md5(T.tidy(F.col("text"))).alias("tidy"))


@query(None)
def normalised_text(s, d):
    """X3 with NFKC (no SQL function has it; tested against unicodedata)."""
    return _docs(s, d).select("doc_id", F.md5(T.tidy(T.nfkc("text"))).alias("normal"))


@query(None)
def placeless_text(s, d):
    """Place names by suffix go, protected terms stay (tested by examples)."""
    strip = T.strip_places(["ville", "burg", "ton"], ["Hamilton"])
    return _docs(s, d).select("doc_id", F.md5(strip("text")).alias("placeless"))


@query("""SELECT p_partkey, list_sort(list_distinct(list_filter(flatten(list_transform(range(2, 17), lambda k: list_transform(range(1, greatest(length(p_name) - k + 2, 2)), lambda i: substring(p_name, i, k)))),
lambda g: length(g) >= 2 AND length(g) <= length(p_name) AND NOT regexp_matches(g, '\\s') AND regexp_matches(g, '[\\p{L}\\p{N}]')))) AS terms FROM part""".replace("\\\\", "\\"))
def header_term_sets(s, d):
    """Substrings of two to sixteen characters of each name."""
    return table(s, d, "part").select("p_partkey", F.array_sort(T.header_terms(F.col("p_name"))).alias("terms"))


@query(None)
def headerless_text(s, d):
    """Each document loses its source's header terms (greedy; tested by examples)."""
    docs = _docs(s, d)
    terms = bounded(docs.select("source").distinct().select("source", T.header_terms(F.col("source"), 4, 16).alias("terms")), "terms")
    return docs.join(terms, "source", "left").select("doc_id", F.md5(T.strip_header_terms("text", "terms")).alias("rest"))


@query("""WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), need AS (SELECT ceil(count(*) * 0.3e0) AS k FROM t),
g AS (SELECT text, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) AS term FROM t WHERE length(text) >= 3),
h AS (SELECT text, unnest(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4)))) AS term FROM t WHERE length(text) >= 4),
g3 AS (SELECT term, count(*) AS n FROM g GROUP BY term HAVING count(*) >= (SELECT k FROM need)), g4 AS (SELECT term, count(*) AS n FROM h GROUP BY term HAVING count(*) >= (SELECT k FROM need)),
inner_ AS (SELECT term[1:3] AS t FROM g4 UNION SELECT term[2:4] FROM g4)
SELECT term, n FROM g3 WHERE term NOT IN (SELECT t FROM inner_) UNION ALL SELECT term, n FROM g4""")
def frequent_substrings(s, d):
    """Maximal substrings of three or four characters that 30 % of the distinct documents share."""
    return T.frequent_substrings(_docs(s, d), "doc_id", "text", share=0.3, least=3, most=4).select("term", "n")


def _notes(s, d):
    """Short notes with a common opening and closing for each group: (id, group, note)."""
    o = table(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), F.col("o_custkey") % 40).alias("project"),
        F.concat(F.lit("Report on group "), F.col("o_custkey") % 40, F.lit(". Status "), "o_orderstatus", F.lit(", priority "), "o_orderpriority", F.lit(", kept at Bramville"), F.col("o_orderkey") % 1000, F.lit(". End of report.")).alias("note"),
    )


@query(None)
def template_terms(s, d):
    """The boilerplate of each project's notes (level by level; tested against a plain search)."""
    return T.template_terms(_notes(s, d), "id", "note", "project")


@query(None)
def depersonalised(s, d):
    """X11: normalised, freed of header terms, places and boilerplate, in that order (composed; tested by examples and by itself)."""
    n = _notes(s, d).withColumn("headers", F.array(F.lit("group")))
    out, _ = T.depersonalise(n, "note", ["normalise", "header", "place", "template"], headers="headers", partition="project", doc="id", suffixes=["ville"], protected=["Status"], run=None)
    return out.select("id", "note")


@query(None)
def depersonalise_statistics(s, d):
    """What each step of the composed strip removed."""
    n = _notes(s, d).withColumn("headers", F.array(F.lit("group")))
    return T.depersonalise(n, "note", ["normalise", "header", "place", "template"], headers="headers", partition="project", doc="id", suffixes=["ville"], protected=["Status"], run=None)[1]


_SIZES = "concat('hail of ', CASE o_orderkey % 5 WHEN 0 THEN 'golf ball size' WHEN 1 THEN '1.75 inch' WHEN 2 THEN 'quarter-sized' WHEN 3 THEN '3/4 in' ELSE 'great size' END, ' stones near ', o_orderstatus)"


@query("""SELECT o_orderkey, 'hail of ' || CASE o_orderkey % 5 WHEN 4 THEN 'great size ' WHEN 3 THEN '3/ ' ELSE '' END || 'stones near ' || o_orderstatus AS rest FROM orders""")
def size_cues(s, d):
    """Words and lengths that tell a size go."""
    return table(s, d, "orders").select("o_orderkey", T.strip_sizes(F.expr(_SIZES)).alias("rest"))


_ROCK = "concat(CASE id % 4 WHEN 0 THEN '粗砂混じり' WHEN 1 THEN '風化した花崗岩' WHEN 2 THEN '粘土質シルト' ELSE '暗褐色ローム' END, CASE id % 3 WHEN 0 THEN '、礫20%' WHEN 1 THEN '。含水多い' ELSE '' END)"
_SOIL = "concat(CASE id % 4 WHEN 0 THEN 'Firm brown sandy CLAY' WHEN 1 THEN 'fine to medium SAND with GRAVEL' WHEN 2 THEN 'weathered grey MUDSTONE' ELSE 'topsoil' END, CASE id % 3 WHEN 0 THEN ' 45 %' ELSE '' END)"


def _sql_families(language: str, text: str) -> str:
    t = f"lower({text})" if language == "en" else text
    parts = [f"[{', '.join(f'CAST(contains({t}, {w!r}) AS INT)' for w in ws)}] AS {n}" for n, ws in T.FAMILIES[language].items()]
    return ", ".join(parts)


_P = "(SELECT o_orderkey AS id FROM orders)"


@query(f"""WITH t AS (SELECT id, {_ROCK} AS x FROM {_P}) SELECT id, {_sql_families('ja', 'x')}, CASE WHEN id % 3 = 0 THEN [0, 1, 0, 0] ELSE [0, 0, 0, 0] END AS percent,
CASE WHEN x LIKE '%岩%' THEN 'rock' WHEN x LIKE '%礫%' THEN 'gravel' WHEN x LIKE '%砂%' THEN 'sand' WHEN x LIKE '%シルト%' THEN 'silt' WHEN x LIKE '%ローム%' THEN 'loam' ELSE 'other' END AS coarse FROM t""")
def descriptors_ja(s, d):
    """The eight descriptor families of Japanese descriptions, and their coarse class by precedence."""
    t = table(s, d, "orders").selectExpr("o_orderkey AS id").select("id", F.expr(_ROCK).alias("x"))
    return t.select("id", *[c.alias(n) for n, c in T.descriptor_families(F.col("x"), "ja").items()], T.coarse_class(F.col("x"), "ja").alias("coarse"))


@query(f"""WITH t AS (SELECT id, {_SOIL} AS x FROM {_P}) SELECT id, {_sql_families('en', 'x')}, CASE WHEN id % 3 = 0 THEN [0, 0, 1, 0] ELSE [0, 0, 0, 0] END AS percent,
CASE id % 4 WHEN 0 THEN 'CLAY' WHEN 1 THEN 'GRAVEL' WHEN 2 THEN 'MUDSTONE' ELSE 'other' END AS coarse FROM t""")
def descriptors_en(s, d):
    """The same of English descriptions; the class is the last capitalised principal noun."""
    t = table(s, d, "orders").selectExpr("o_orderkey AS id").select("id", F.expr(_SOIL).alias("x"))
    return t.select("id", *[c.alias(n) for n, c in T.descriptor_families(F.col("x"), "en").items()], T.coarse_class(F.col("x"), "en").alias("coarse"))


_TOWN = "concat(CASE id % 4 WHEN 0 THEN '東京駅' WHEN 1 THEN '第三工区' WHEN 2 THEN '火山灰質の砂' ELSE '岩級区分' END, '、砂混じり、', CASE id % 3 WHEN 0 THEN '相模原市' WHEN 1 THEN 'ローム' ELSE '荒川' END)"


@query(f"""SELECT id, CASE id % 4 WHEN 2 THEN '火山灰質の砂' WHEN 3 THEN '岩級区分' ELSE '' END AS a, md5(trim(regexp_replace(CASE id % 4 WHEN 2 THEN '火山灰質の砂' WHEN 3 THEN '岩級区分' ELSE ' ' END || '、砂混じり、' || CASE id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'ローム' ELSE '荒川' END, '\\s+', ' ', 'g'))) AS rest FROM {_P}""")
def placeless_japanese(s, d):
    """Japanese place names of two to eight characters with their suffix go; short ones and protected terms stay."""
    t = table(s, d, "orders").selectExpr("o_orderkey AS id").select("id", F.expr(_TOWN).alias("x"))
    strip = T.strip_places(T.PLACE_SUFFIXES, ["火山灰"], run=T.NAME_CHARACTERS, not_before=T.NOT_AFTER)
    return t.select("id", F.expr("CASE id % 4 WHEN 2 THEN '火山灰質の砂' WHEN 3 THEN '岩級区分' ELSE '' END").alias("a"), F.md5(strip("x")).alias("rest"))


@query(None)
def headerless_japanese(s, d):
    """Header terms go from compounds of Kanji but not from inside words of one script (greedy; tested by examples)."""
    t = table(s, d, "orders").selectExpr("o_orderkey AS id").select("id", F.expr(_TOWN).alias("x"), F.array(F.lit("東京"), F.lit("砂"), F.lit("ーム"), F.lit("工区")).alias("terms"))
    return t.select("id", T.strip_header_terms("x", "terms", ["火山灰"]).alias("rest"))


@query("""SELECT p_partkey, replace(replace(p_name, split_part(p_type, ' ', 1), ' '), 'part', ' ') AS rest FROM part""")
def remove_terms(s, d):
    """An array of terms removed, longest first."""
    return table(s, d, "part").select("p_partkey", T.remove_terms(F.col("p_name"), F.array(F.lit("part"), F.concat(F.substring_index("p_type", " ", 1)))).alias("rest"))


@query("""WITH t AS (SELECT o_orderkey, 'share ' || (o_custkey % 130) || ' % and ' || (o_orderkey % 45) || '%' AS x, greatest(o_custkey % 130, o_orderkey % 45) AS m FROM orders)
SELECT o_orderkey, CASE WHEN m < 10 THEN 0 WHEN m < 30 THEN 1 WHEN m < 60 THEN 2 ELSE 3 END AS bin FROM t""")
def percent_bins(s, d):
    """The greatest percentage of a text, binned."""
    t = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("share "), F.col("o_custkey") % 130, F.lit(" % and "), F.col("o_orderkey") % 45, F.lit("%")).alias("x"))
    return t.select("o_orderkey", T.percent_bin(F.col("x")).alias("bin"))


@query("""WITH t AS (SELECT item_id, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT doc_id AS item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY item_id, w),
g AS (SELECT item_id, c, substring(w, i, k) AS term FROM t, range(2, 5) kk(k), range(1, 200) ii(i) WHERE i <= length(w) - k + 1),
tf AS (SELECT item_id, term, sum(c) AS tf FROM g GROUP BY item_id, term),
top AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5 ORDER BY sum(tf) DESC, term LIMIT 400),
x AS (SELECT item_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM tf JOIN top ON tf.term = top.term)
SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM x""".replace("\\\\", "\\"))
def ngram_tfidf(s, d):
    """Character n-gram weights of all documents; the 400 commonest terms are the vocabulary."""
    return T.tfidf(_docs(s, d).select(F.col("doc_id").alias("item_id"), "text"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query("""SELECT p_partkey, CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN 'UNKNOWN' WHEN contains(p_type, 'STEEL') OR contains(p_type, 'TIN') THEN 'metal' WHEN contains(p_type, 'PROMO') THEN 'offer' ELSE 'OTHER' END AS kind,
'_strip-' || lower(split_part(p_type, ' ', 1)) AS tag FROM part""")
def rule_classes(s, d):
    """The first rule that holds; a tag."""
    t = F.col("p_type")
    return table(s, d, "part").select("p_partkey", T.first_rule(t, [("metal", ["STEEL", "TIN"]), ("offer", ["PROMO"])]).alias("kind"), T.cache_tag(F.lower(F.substring_index(t, " ", 1))).alias("tag"))


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS label, CASE WHEN year(o_orderdate) BETWEEN 1930 AND 1996 THEN year(o_orderdate) END AS year,
o_orderkey * 1000 + 0.5e0 AS number, round(35 + (o_orderkey % 60) / 60 + (o_custkey % 60) / 3600, 9) AS degrees, o_orderstatus || '|' || (o_custkey % 4) AS stratum FROM orders""")
def parsed_fields(s, d):
    """Fallbacks, years in a window, numbers with commas, degrees, composite labels."""
    o = table(s, d, "orders")
    return o.select(
        "o_orderkey", T.first_filled(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")).alias("label"),
        T.valid_year(F.col("o_orderdate").cast("string"), high=1996).cast("bigint").alias("year"), T.number(F.concat(F.col("o_orderkey"), F.lit(",000.5"))).alias("number"),
        F.round(T.degrees(F.lit(35.0), F.col("o_orderkey") % 60, F.col("o_custkey") % 60), 9).alias("degrees"), F.concat_ws("|", "o_orderstatus", F.col("o_custkey") % 4).alias("stratum"),
    )
