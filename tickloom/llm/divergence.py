"""Source divergence audit: how far each source's words are from those of the other sources of its language and of the language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, quoted

#: A term is a match of [^\x00-\x40\x5B-\x60\x7B-\x7F]+: letters A-Z and a-z and every character beyond ASCII. This is what lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A share of one.
UNIT = 1_000_000_000
#: Parts into which each language's vocabulary is dealt where it meets the language's sources.
SALTS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else: lower() where the text is ASCII, translate() elsewhere."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact for counts of up to 19 digits."""
    return F.expr(f"1 + cast(cast({count} + 1 as decimal(19, 0)) * cast({UNIT} as decimal(10, 0)) div cast({total} + {terms} as decimal(19, 0)) as bigint)")


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits in a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def source_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term and the rows that hold it.

    The matches are taken as what a split at everything between them leaves, which takes a quarter of the time that a list of matches
    takes. A row's terms are sorted, so that the first of equal ones marks its row; both counts are then one aggregate, combined
    before the shuffle. Nulls read as empty."""
    rows = docs.select(
        *(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text")))
    )
    found = F.sort_array(F.split(lower_ascii(F.col("text")), BETWEEN))
    # exploded from a list of one list, the terms are a column of their own: inlined into the next step, they would be made again for each
    lists = rows.select("lang", "source", F.explode(F.array(found)).alias("terms"))
    each = lists.select("lang", "source", "terms", F.posexplode("terms").alias("i", "term")).where("term <> ''")  # before the first and after the last
    first = F.expr("cast(i = 0 or terms[i - 1] <> term as bigint)")
    return each.select("lang", "source", "term", first.alias("first")).groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("n_docs"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of docs.

    A language keeps the terms that at least min_docs of its rows hold. Each group and each language gives every kept term a smoothed
    share; excess() says how far a group's share is above or below another's. Part `pair`: the other sources of the language, by
    the sum of excess() over all kept terms. Part `term`: the terms that the group has more of than the language, by excess(), the
    first `top`. Ranks count from 1 by value, highest first, equal values by item bytewise.

    Plain relational: terms are exploded and counted once, and the counts written (a row a group and term), since all else reads them.
    Groups and kept terms are numbered, so that the joins of dense rows are on numbers. The vocabulary meets the language's
    sources to make zeros dense: an equality join on language and a salt of the term, so one language is many tasks. The dense shares
    are joined with themselves on the term (a number stands for language and term): a term meets the square of its language's sources,
    each two of them once, for both directions; sums are combined before the shuffle. Ranks of terms are limited within each task first. No
    broadcast is asked for: only what Spark knows to be small is sent whole.

    Null lang, source or text read as empty; a group without terms has zero counts; a language that keeps no term has pairs of
    value 0; repeated rows count each; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(*(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))))
    groups = cut(rows.distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    counts = cut(source_terms(docs, lang_col, source_col, text_col), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("held")).where(F.col("held") >= min_docs)
    kept = cut(kept.select("lang", "term", "n_lang", F.monotonically_increasing_id().alias("t")), "kept")
    own = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).join(groups, ["lang", "source"])
    own = cut(own.select("g", "t", "term", "n", "n_lang"), "own")
    totals = kept.groupBy("lang").agg(F.sum("n_lang").alias("all_lang"), F.count("*").alias("v"))
    sized = groups.join(own.groupBy("g").agg(F.sum("n").alias("total")), "g", "left").join(totals, "lang")
    sized = cut(sized.select("g", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "all_lang"), "sized")

    salt = F.pmod("t", F.lit(SALTS)).cast("int")
    salted = sized.select("lang", "g", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dense = kept.select("lang", "t", salt.alias("salt")).join(salted, ["lang", "salt"]).select("t", "g", "total", "v")
    dense = dense.join(own.select("t", "g", "n"), ["t", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = cut(dense.select("t", "g", share("n", "total", "v").alias("p")), "dense")
    twice = dense.join(dense.select("t", F.col("g").alias("h"), F.col("p").alias("q")), "t").where("g < h")
    twice = twice.groupBy("g", "h").agg(F.sum(excess("p", "q")).alias("on"), F.sum(excess("q", "p")).alias("back"))
    apart = twice.select(F.inline(F.array(F.struct("g", "h", F.col("on").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))))

    item = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = groups.join(item, "lang").where("g <> h").join(apart, ["g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    over = own.join(sized, "g").withColumn("p", share("n", "total", "v")).withColumn("q", share("n_lang", "all_lang", "v")).where("p > q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top))
