"""Text normalisation, stripping, parsing and rule classifiers, as expressions where SQL has them."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corelog.operators.common import bounded, kept
from corelog.plans.ship import ship


def base_name(path: Column) -> Column:
    """What follows the last / or backslash."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def tidy(text: Column) -> Column:
    """Literal backslash-n and runs of white space as one space, trimmed; idempotent."""
    return F.trim(F.regexp_replace(text, r"(\\n|[\s　])+", " "))


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility form, in Arrow batches; SQL has no such function."""
    ship(SparkSession.active())
    return _of_rows(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))(text)


#: Rows of an Arrow batch that are Python objects at a time.
UDF_ROWS = 200


def _of_rows(each):
    """A UDF of strings that applies `each` to the values of each row. Of a batch, which Spark bounds in rows and bytes, only
    UDF_ROWS rows at a time are Python objects, and what they give leaves the worker before the next are read."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for start in range(0, len(columns[0]), UDF_ROWS):
                rows = zip(*[c.slice(start, UDF_ROWS) for c in columns])
                yield pa.array([each(*[v.as_py() for v in row]) for row in rows], pa.string())

    return run


def strip_words(text: Column, words: list[str], *, ignore_case: bool = False, whole: bool = True) -> Column:
    """The words, longest first, each as one space; then white space collapses."""
    alt = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    pattern = ("(?i)" if ignore_case else "") + (rf"\b(?:{alt})\b" if whole else f"(?:{alt})")
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, " "), r"\s+", " "))


def strip_modes(text: Column, materials: list[str], strengths: list[str], mode: str) -> Column:
    """'full', 'lithology_only' or 'hardness_only': material words (as written) and strength words (any case) removed."""
    if mode not in ("full", "lithology_only", "hardness_only"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "hardness_only":
        text = strip_words(text, materials)
    if mode != "lithology_only":
        text = strip_words(text, strengths, ignore_case=True)
    return text


def cache_tag(mode: Column) -> Column:
    return F.when(mode.isNull() | (mode == "none"), "").otherwise(F.concat(F.lit("_strip-"), mode))


def remove_terms(text: Column, terms: Column) -> Column:
    """The array's terms as spaces, longest first."""
    longest = F.array_sort(F.filter(terms, lambda t: F.length(t) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda acc, t: F.replace(acc, t, F.lit(" ")))


def removal_counts(before: str, after: str) -> list[Column]:
    """Characters removed, whether the text changed, whether it was emptied: 0 or 1 each."""
    b, a = F.coalesce(F.col(before), F.lit("")), F.coalesce(F.col(after), F.lit(""))
    return [(F.length(b) - F.length(a)).cast("bigint"), (b != a).cast("bigint"), ((F.length(F.trim(b)) > 0) & (F.length(F.trim(a)) == 0)).cast("bigint")]


def removal_stats(before: str, after: str) -> list[Column]:
    """Aggregates: characters removed, texts changed, texts emptied."""
    return [F.sum(c).alias(n) for c, n in zip(removal_counts(before, after), ("chars_removed", "texts_changed", "texts_emptied"))]


def header_terms(field: Column, least: int = 2, most: int = 16) -> Column:
    """Distinct substrings of least to most characters without a space and with a letter or digit."""
    n = F.length(field)
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(field, i, k))
    grams = F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), at))
    ok = lambda g: (F.length(g) >= least) & ~g.rlike(r"\s") & g.rlike(r"[\p{L}\p{N}]")
    return F.array_distinct(F.filter(grams, lambda g: ok(g) & (F.length(g) <= n)))


_WORD_SCRIPTS = re.compile("(?P<katakana>[ァ-ヺーヽヾ゛゜])|(?P<hiragana>[ぁ-\u309f])|(?P<latin>[0-9A-Za-z])")


def _script(ch: str) -> str:
    """The script whose runs are words: katakana, hiragana, ASCII letters and digits. Kanji and all else have none: they
    may be parted anywhere, as compounds are written without spaces."""
    m = _WORD_SCRIPTS.match(ch)
    return m.lastgroup if m else ""


def delete_terms(text: str, terms: set[str], most: int = 16, find=None, protected: list[str] | None = None) -> str:
    """Greedy longest matches from left to right as spaces; a match may not cut a word of one script in two.

    find: term_finder(terms), which jumps to the places where some term begins. protected: terms that are out of reach.
    """
    if protected:
        text = mask(text, protected)
    out, i, n = [], 0, len(text)
    find = find or term_finder(terms)
    while m := find(text, i):
        at = m.start()
        out.append(text[i:at])
        for k in range(min(most, n - at), 1, -1):
            j = at + k
            if text[at:j] in terms and not (at and _same_script(text[at - 1], text[at])) and not (j < n and _same_script(text[j - 1], text[j])):
                out.append(" ")
                i = j
                break
        else:
            out.append(text[at])
            i = at + 1
    out.append(text[i:])
    found = " ".join("".join(out).split())
    return unmask(found, protected) if protected else found


def term_finder(terms: set[str]):
    """Searches for the next place from which some term stands."""
    if not terms:
        return lambda text, i: None
    return re.compile("|".join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t))))).search


def _same_script(a: str, b: str) -> bool:
    return bool(_script(a)) and _script(a) == _script(b)


def strip_header_terms(text: Column | str, terms: Column | str, protected: list[str] | None = None) -> Column:
    """delete_terms() of each text with its own array of terms; NULL stays, no terms leave the text as it is. Protected
    vocabulary is never cut."""
    ship(SparkSession.active())
    known: dict[tuple, tuple] = {}

    def strip(t, ts):
        if t is None or not ts:
            return t
        key = tuple(ts)
        if key not in known:
            if len(known) > 100:
                known.clear()
            known[key] = (set(key), term_finder(set(key)))
        return delete_terms(t, known[key][0], find=known[key][1], protected=protected)

    return _of_rows(strip)(text, terms)


def mask(text: str, protected: list[str]) -> str:
    """Protected terms as private-use characters, longest first."""
    for i, t in sorted(enumerate(protected), key=lambda x: -len(x[1])):
        text = text.replace(t, chr(0xE000 + i))
    return text


def unmask(text: str, protected: list[str]) -> str:
    return re.sub("[-]", lambda m: protected[ord(m[0]) - 0xE000] if ord(m[0]) - 0xE000 < len(protected) else m[0], text)


#: Words for sizes of hail and the like, and lengths with a unit.
_THINGS = "apple|baseball|cd|dime|dvd|egg|golf[ -]?ball|grapefruit|half[ -]?dollar|hen[ -]?egg|lime|marble|mothball|nickel|pea|penny|ping[ -]?pong|quarter|softball|tea[ -]?cup|tennis[ -]?ball|walnut"
SIZE_CUES = rf"(?i)\b(?:{_THINGS})(?:[ -]?sized?)?\b|\bdollar[ -]?sized?\b|\b\d+(?:\.\d+)?[\s-]*(?:mm|cm|in|inch(?:es)?)\b|\b\d+(?:\.\d+)?\s*\"|\b(?:quarters|halfs?|halves|three[ -]?quarters?)\b"


def strip_sizes(text: Column) -> Column:
    """Size cues as one space each, then white space collapses: what tells a size in words goes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, SIZE_CUES, " "), r"\s+", " "))


#: Characters of names, and what follows a place's name. Suffixes that stand in terms of rock and soil as a rule aren't here.
NAME_CHARACTERS = "[一-鿿々ァ-ヺー]"
PLACE_SUFFIXES = [*"市町村郡府県都山川湖島港橋駅", *"団地 地内 地先 地区 工区".split()]
#: Followed by these, a suffix is part of another word.
NOT_AFTER = ["分", "間"]


def strip_places(suffixes: list[str], protected: list[str], *, run: str | None = None, least: int = 2, most: int = 8, not_before: list[str] | None = None):
    """A UDF that deletes names before a place suffix, with it; protected terms stay.

    run: a character class, of which least to most characters are a name (NAME_CHARACTERS for Japanese; not_before then
    names what must not follow the suffix). Without it a name is a capital and least to most small letters, a word whole.
    """
    ship(SparkSession.active())
    ends = "|".join(map(re.escape, sorted(suffixes, key=lambda t: (-len(t), t))))
    after = f"(?!{'|'.join(map(re.escape, not_before))})" if not_before else ""
    pattern = re.compile(rf"{run}{{{least},{most}}}(?:{ends}){after}" if run else rf"\b[A-Z][a-z]{{{least},{most}}}(?:{ends})\b{after}")
    return _of_rows(lambda t: t if t is None else unmask(" ".join(pattern.sub(" ", mask(t, protected)).split()), protected))


def percent_bin(text: Column) -> Column:
    """0 to 3 for the greatest percentage in the text below 10, 30, 60 or not; -1 without one."""
    top = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(\\d{1,3})\\s*[%％]"), 1), lambda x: x.cast("int")))
    return F.when(top.isNull(), -1).when(top < 10, 0).when(top < 30, 1).when(top < 60, 2).otherwise(3)


def first_rule(text: Column, rules: list[tuple[str, list[str]]], unknown: str = "UNKNOWN", other: str = "OTHER") -> Column:
    """The first rule one of whose words stands in the text; NULL and blank are unknown, others `other`."""
    out = F.when(text.isNull() | (F.trim(text) == ""), unknown)
    for name, ws in rules:
        hit = F.lit(False)
        for w in ws:
            hit = hit | text.contains(w)
        out = out.when(hit, name)
    return out.otherwise(other)


def last_capitalised(text: Column) -> Column:
    """The last run of two or more capitals; '' without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit("([A-Z]{2,})"), 1), F.lit(-1)), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def valid_year(*dates: Column, low: int = 1930, high: int = 2030) -> Column:
    """The first year of four digits, at a text's start, inside the window."""
    years = [F.regexp_extract(d, r"^\s*(\d{4})", 1).try_cast("int") for d in dates]
    return F.coalesce(*[F.when(y.between(low, high), y) for y in years])


def number(text: Column) -> Column:
    """A double of text with thousands commas; NULL for blank or anything else."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("double")


def degrees(d: Column, m: Column, s: Column) -> Column:
    return d + m / 60 + s / 3600


#: A chunk of texts that is searched at once has about so many characters, and not fewer texts than CHUNK_TEXTS as a rule.
CHUNK_CHARACTERS = 2_000_000
CHUNK_TEXTS = 100


def frequent_substrings(df: DataFrame, doc: str, text: str, *, share: float = 0.9, least: int = 6, most: int = 120, partition: list[str] | None = None) -> DataFrame:
    """(partition, term, n): maximal substrings of least to most characters that stand in ceil(share n) of the distinct
    texts of a partition (all as one without it).

    Texts of a partition are hashed into chunks of some CHUNK_CHARACTERS. What stands in ceil(share n) of all of them stands
    in that share of some chunk at least, so each chunk alone is searched level by level as in Apriori: a length's candidates
    are those whose prefix and suffix were frequent. What a chunk finds is then counted in all chunks of its partition, if
    there are several. A term inside a longer frequent one isn't maximal.
    """
    ship(SparkSession.active())
    by = partition or []
    d = kept(df.where(F.col(text).isNotNull()).select(*by, text).distinct(), "texts")
    chunks = F.greatest(F.lit(1), F.least(F.floor(F.sum(F.length(text)) / CHUNK_CHARACTERS), F.floor(F.count("*") / CHUNK_TEXTS))).cast("int")
    sizes = bounded(d.groupBy(*by).agg(F.ceil(F.count("*") * share).alias("_need"), chunks.alias("_chunks")), "sizes")
    d = d.join(sizes, by) if by else d.crossJoin(F.broadcast(sizes))
    d = d.withColumn("_c", F.pmod(F.xxhash64(text), F.col("_chunks")).cast("int"))
    keys = [*by, "_c"]
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "term string, n bigint"])

    def table(first: pd.DataFrame, counts: list[tuple[str, int]]) -> pd.DataFrame:
        out = pd.DataFrame(counts, columns=["term", "n"]).astype({"n": "int64"})
        for c in reversed(by):
            out.insert(0, c, [first[c].iloc[0]] * len(out))
        return out

    def search(f: pd.DataFrame) -> pd.DataFrame:
        return table(f, frequent_inside(f[text].tolist(), share, least, most))

    def recount(f: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        return table(terms, list(holders_of(f[text].tolist(), terms["term"].tolist()).items()))

    whole = kept(d.where("_chunks = 1").groupBy(*keys).applyInPandas(search, schema), "terms")
    some = kept(d.where("_chunks > 1").groupBy(*keys).applyInPandas(search, schema).select(*by, "term").distinct(), "terms")
    if not some.isEmpty():
        asked = (some.join(sizes, by) if by else some.crossJoin(F.broadcast(sizes))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        counted = d.where("_chunks > 1").select(*keys, text).groupBy(*keys).cogroup(asked.select(*keys, "term").groupBy(*keys)).applyInPandas(recount, schema)
        whole = whole.unionByName(counted.groupBy(*by, "term").agg(F.sum("n").alias("n")))
    found = whole.join(sizes, by) if by else whole.crossJoin(F.broadcast(sizes))
    found = kept(found.where(F.col("n") >= F.col("_need")).select(*by, "term", "n"), "terms")
    inner = found.where(F.length("term") > least).select(*by, F.explode(F.array(F.expr("substring(term, 1, length(term) - 1)"), F.expr("substring(term, 2)"))).alias("term"))
    return found.join(inner, [*by, "term"], "left_anti")


def frequent_inside(texts: list[str], share: float, least: int, most: int) -> list[tuple[str, int]]:
    """(substring, texts) of all substrings of least to most characters that stand in `share` of the texts."""
    floor = share * len(texts) - 1e-6
    at: list = [range(len(t) - least + 1) for t in texts]
    out: list[tuple[str, int]] = []
    for k in range(least, most + 1):
        counts: Counter = Counter()
        for t, places in zip(texts, at):
            counts.update({t[i : i + k] for i in places})
        good = {g for g, c in counts.items() if c >= floor}
        if not good:
            break
        out += [(g, counts[g]) for g in good]
        if k < most:
            # A longer one begins where this length is frequent, here and at the next character.
            hits = [[i for i in places if t[i : i + k] in good] for t, places in zip(texts, at)]
            at = [[i for i, j in zip(p, p[1:]) if j == i + 1] for p in hits]
    return out


def holders_of(texts: list[str], terms: list[str]) -> Counter:
    """How many of the texts hold each term."""
    sized: dict[int, set[str]] = {}
    for t in terms:
        sized.setdefault(len(t), set()).add(t)
    n: Counter = Counter()
    for text in texts:
        for k, some in sized.items():
            n.update(some & {text[i : i + k] for i in range(len(text) - k + 1)} if len(text) < 3 * len(some) else [t for t in some if t in text])
    return n


def template_terms(df: DataFrame, doc: str, text: str, partition: str, *, share: float = 0.9, least: int = 6, most: int = 120, least_texts: int = 5) -> DataFrame:
    """(partition, terms): the boilerplate of each partition of least_texts distinct texts or more, as an array, longest first.

    All texts count: none is thinned out, however large a partition is. Rows with a NULL partition have none.
    """
    some = df.where(F.col(partition).isNotNull() & F.col(text).isNotNull())
    enough = some.select(partition, text).distinct().groupBy(partition).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_texts)
    found = frequent_substrings(some.join(enough.drop("_n"), partition, "left_semi"), doc, text, share=share, least=least, most=most, partition=[partition])
    longest = F.array_sort(F.collect_set("term"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return found.groupBy(partition).agg(longest.alias("terms"))


def depersonalise(df: DataFrame, text: str, steps: list[str], *, headers: str | None = None, partition: str | None = None, doc: str | None = None, suffixes: list[str] | None = None, protected: list[str] | None = None, share: float = 0.9, run: str | None = NAME_CHARACTERS) -> tuple[DataFrame, DataFrame]:
    """(df with `text` stripped, statistics): 'normalise', 'header', 'place' and 'template' in the order of `steps`.

    headers: an array column of terms for 'header'; partition and doc: for 'template'. White space is tidied after each
    step, and what a step deletes leaves a space, so that applying it all again changes nothing. The statistics are a row
    a step: (step, chars_removed, texts_changed, texts_emptied). Unknown steps, or none, are a ValueError.
    """
    known = {"header", "normalise", "place", "template"}
    if (bad := set(steps) - known) or not steps:
        raise ValueError(f"unknown steps: {sorted(bad)}")
    stats, names, columns = [], [], df.columns
    for i, step in enumerate(steps):
        before, after = (text if i == 0 else f"_t{i - 1}"), f"_t{i}"
        names.append(after)
        if step == "normalise":
            df = df.withColumn(after, tidy(nfkc(before)))
        elif step == "header":
            df = df.withColumn(after, tidy(strip_header_terms(before, headers, protected)))
        elif step == "place":
            df = df.withColumn(after, tidy(strip_places(suffixes or PLACE_SUFFIXES, protected or [], run=run, not_before=NOT_AFTER)(before)))
        else:
            terms = bounded(template_terms(df, doc, before, partition, share=share).withColumnRenamed("terms", "_terms"), "terms")
            df = df.join(terms, partition, "left").withColumn(after, F.when(F.col("_terms").isNull(), F.col(before)).otherwise(tidy(remove_terms(F.col(before), F.col("_terms"))))).drop("_terms")
        stats.append(F.struct(F.lit(step).alias("step"), *[c.alias(n) for c, n in zip(removal_counts(before, after), ("chars_removed", "texts_changed", "texts_emptied"))]))
    df = kept(df, "stripped")
    counted = df.select(F.explode(F.array(*stats)).alias("s")).groupBy("s.step").agg(*[F.sum(f"s.{n}").alias(n) for n in ("chars_removed", "texts_changed", "texts_emptied")])
    return df.select(*[F.col(names[-1]).alias(c) if names and c == text else c for c in columns]), counted


#: Words of the descriptor families, by language and family.
FAMILIES = {
    "ja": {
        "grain": "シルト質 中砂 中礫 砂質 礫質 粗砂 粗礫 粘土質 細砂 細礫".split(),
        "sorting": "不均一 不均質 分級 均一 均質 淘汰".split(),
        "class": "シルト ローム 凝灰 安山 岩 有機質 泥 火山灰 玄武 石灰 砂 礫 粘土 腐植 花崗 貝殻 軽石".split(),
        "weathering": "新鮮 酸化 風化".split(),
        "water": "乾燥 含水 湿潤 飽和".split(),
        "angularity": "亜円 亜角 円礫 角礫".split(),
        "colour": "灰 白 緑 褐 赤 青 黄 黒".split(),
    },
    "en": {
        "grain": "coarse fine medium".split(),
        "sorting": [f"{how} {what}" for what in ("graded", "sorted") for how in ("poorly", "well")] + ["gap graded", "uniformly graded"],
        "class": "boulders chalk clay claystone cobbles dolomite gravel limestone marl mudstone peat sand sandstone silt siltstone till topsoil".split() + ["made ground"],
        "secondary": "clayey gravelly sandy silty slightly very".split(),
        "weathering": "fresh oxidised oxidized weathered".split(),
        "angularity": "angular rounded sub-angular sub-rounded subangular subrounded".split(),
        "colour": "black blue brown gray green grey orange red white yellow".split(),
    },
}


def descriptor_families(text: Column, language: str) -> dict[str, Column]:
    """An array of 0 and 1 for each family: which of its words the text holds; 'percent' is the bin of its greatest percentage.
    English words are looked for in any case. NULL counts as empty."""
    t = F.coalesce(F.lower(text) if language == "en" else text, F.lit(""))
    out = {name: F.array(*[t.contains(w).cast("int") for w in words]) for name, words in FAMILIES[language].items()}
    top = percent_bin(t)
    return out | {"percent": F.array(*[(top == i).cast("int") for i in range(4)])}


#: Coarse classes in their order of precedence.
COARSE_JA = [("rock", "岩|安山|玄武|花崗|凝灰"), ("organic", "ピート|有機|泥炭|腐植"), ("gravel", "玉石|礫|れき"), ("sand", "砂"), ("silt", "シルト"), ("clay", "粘性|粘土|ねんど"), ("loam", "火山灰|ローム"), ("mud", "どろ|泥")]
COARSE_EN = "BOULDERS CHALK CLAY COBBLES GRAVEL LIMESTONE MUDSTONE PEAT SAND SANDSTONE SILT SILTSTONE TILL".split()


def coarse_class(text: Column, language: str) -> Column:
    """'ja': the first class of COARSE_JA whose words stand in the text; 'en': the last whole capitalised word of COARSE_EN. Else 'other'."""
    if language == "en":
        found = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(COARSE_EN)})\b"), 1)
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("other"))
    out = F.when(text.isNull(), "other")
    for name, pattern in COARSE_JA:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def _grams(w: Column, k: int, *, shorter: bool) -> Column:
    """All substrings of k characters; a shorter w is one itself if `shorter`, else none."""
    whole = F.transform(F.sequence(F.lit(1), F.length(w) - k + 1), lambda i: F.substring(w, i, k))
    return F.when(F.length(w) >= k, whole).otherwise(F.array(w) if shorter else F.array().cast("array<string>"))


def tfidf(df: DataFrame, doc: str, text: str, *, low: int = 2, high: int = 4, least: int = 5, top: int = 400) -> DataFrame:
    """(doc, term, weight): character n-grams inside words padded by spaces; terms of `least` documents, the `top` of most
    occurrences (ties by term); smooth idf, each document's vector of length 1. Rows of one document count as one.

    No pairs of documents and n-grams are shuffled. Occurrences come from the counts of all words; in their order terms are
    looked up in the documents, twice as many a round, until `top` of them stand in `least` documents or no more are left.
    Then each document's vector is made where its text is read.
    """
    ship(SparkSession.active())
    n = df.count()
    d = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("_d"), F.lower(text).alias("_t"))
    again = kept(d.groupBy("_d").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_d").alias("_a"), F.lit(True).alias("_again")), "again")
    if not again.isEmpty():
        marked = d.join(again, F.col("_d").eqNullSafe(F.col("_a")), "left")
        d = marked.where("_again IS NULL").select("_d", "_t").unionByName(marked.where("_again").groupBy("_d").agg(F.concat_ws(" ", F.collect_list("_t")).alias("_t")))
    words = F.filter(F.split("_t", r"\s+"), lambda w: F.length(w) > 0)
    w = d.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("c")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    each = [_grams(F.col("w"), k, shorter=k == low) for k in range(low, high + 1)]
    totals = w.select("c", F.explode(F.concat(*each)).alias("term")).groupBy("term").agg(F.sum("c").alias("all"))
    totals = kept(totals.where(F.col("all") >= least), "terms")
    read = d.select("_d", F.col("_t").cast("binary").alias("_t"))
    found: list[tuple[str, int]] = []
    seen, more = 0, 2 * top
    while len(found) < top:
        some = [r.term for r in totals.orderBy(F.desc("all"), "term").offset(seen).limit(more).collect()]
        if not some:
            break
        counts = {r.i: r.n for r in read.select("_t").mapInArrow(_holders(some, low, high), "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
        found += [(t, counts[i]) for i, t in enumerate(some) if counts.get(i, 0) >= least]
        seen, more = seen + len(some), 2 * more
    weights = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in found[:top]}
    schema = StructType([StructField(doc, df.schema[doc].dataType), StructField("term", StringType()), StructField("weight", DoubleType())])
    return read.mapInArrow(_vectors(doc, weights, low, high), schema)


def _term_counts(terms: list[str], low: int, high: int):
    """A function from a text in lower case, as UTF-8, to how often it holds each term: {place of the term: count}."""
    at, known = {t: i for i, t in enumerate(terms)}, {}

    def inside(word: bytes) -> list[int]:
        w = f" {word.decode()} "
        grams = [w[i : i + k] for k in range(low, high + 1) for i in range(len(w) - k + 1)]
        return [at[g] for g in (grams if len(w) >= low else [w]) if g in at]

    def count(text: bytes) -> dict[int, int]:
        # Without an argument bytes part at ASCII white space, as the regular expression \s does in SQL.
        out: dict[int, int] = {}
        for word, c in Counter(text.split()).items():
            hits = known.get(word)
            if hits is None:
                hits = inside(word)
                if len(word) <= 64:
                    if len(known) >= 100_000:
                        known.clear()
                    known[word] = hits
            for i in hits:
                out[i] = out.get(i, 0) + c
        return out

    return count


def _holders(terms: list[str], low: int, high: int):
    """For mapInArrow: (place of the term, number of texts that hold it), a row a term and partition."""

    def run(batches):
        import pyarrow as pa

        count, n = _term_counts(terms, low, high), Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(count(text.as_py()).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.int32()), pa.array(list(n.values()), pa.int64())], ["i", "n"])

    return run


def _vectors(doc_name: str, weights: dict[str, float], low: int, high: int, rows: int = 500):
    """For mapInArrow: (document, text) to (document, term, weight), of `rows` documents at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, idf = pa.array(list(weights), pa.string()), np.array(list(weights.values()), float)
        count = _term_counts(list(weights), low, high)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                doc, term, weight = [], [], []
                for i, text in enumerate(part.column(1)):
                    if tf := count(text.as_py()):
                        at = np.fromiter(tf.keys(), np.int64, len(tf))
                        x = np.fromiter(tf.values(), float, len(tf)) * idf[at]
                        doc.append(np.full(len(at), i))
                        term.append(at)
                        weight.append(x / np.sqrt((x * x).sum()))
                if doc:
                    columns = [part.column(0).take(pa.array(np.concatenate(doc))), names.take(pa.array(np.concatenate(term))), pa.array(np.concatenate(weight))]
                    yield pa.RecordBatch.from_arrays(columns, [doc_name, "term", "weight"])

    return run
