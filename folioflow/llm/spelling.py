"""Groups of spelling variants by an even-partition pigeonhole join.

Words are counted over all texts with built-in functions, summed within each task before they are shuffled.
A word of l code points is indexed under two segments, its first l // 2 code points and the rest. One edit
leaves one of the two as it was, so a word of equal or one more code point looks for near words under its
own first l // 2 and last l - l // 2 code points: the second segment is read one place further on in a
longer word. Candidates under one key are verified on what the key doesn't cover, and links found under
both keys are taken once.

Short segments such as common endings may hold a large part of the vocabulary. A key under which more than
`most_pairs` candidates would meet is refined by the same step: the part that it doesn't cover is cut
evenly into two segments again, one of which must match. At the end a key covers all but one code point,
and no more candidates meet under it than the alphabet allows. So no group of all pairs is formed and no link is
lost; where a key is refined depends on counts, the links don't.

Defined results: null texts and texts without a run give no words; a null id counts as the empty text
before the colon; repeated rows count each time. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Java class of the code points that runs consist of.
LETTERS = r"A-Za-zÀ-ÿ"


def run_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, drop_every: int | None = 199) -> DataFrame:
    """A row `word` for every maximal run of letters that has min_length code points or more in the end. Runs are
    lower-cased in A-Z; of a run whose crc32, together with its document's id, is a multiple of drop_every, one
    code point is left out. Shorter runs only ever give shorter words, so the pattern passes over them."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"[{LETTERS}]{{{min_length},}}+"), F.lit(0)))
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("_prefix"), run.alias("_run"))
    plain = F.octet_length("_run") == F.length("_run")
    rows = rows.select("_prefix", F.when(plain, F.lower("_run")).otherwise(ascii_lower(F.col("_run"))).alias("word"))
    if drop_every:
        rows = rows.withColumn("_h", F.crc32(F.concat("_prefix", "word").cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        without = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(F.col("_h") % drop_every == 0, without).otherwise(F.col("word")).alias("word"))
        rows = rows.where(F.length("word") >= min_length)
    return rows.select("word")


def vocabulary(words: DataFrame, min_count: int = 5) -> DataFrame:
    """word, n of the words that occur min_count times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, l, a, b) with the key: the first a and the last b code points, of an indexed length l."""
    left, right = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))
    return rows.withColumn("key", F.concat_ws("|", F.col("l").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), left, right))


def _halves(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """The two ways to cover one more segment of the l - a - b code points that aren't covered yet."""
    rest = l - a - b
    first = F.floor(rest / 2).cast("int")
    ways = F.array(F.struct((a + first).alias("a"), b.alias("b")), F.struct(a.alias("a"), (b + rest - first).alias("b")))
    return F.explode(ways)


def _middle(side: str) -> Column:
    word = F.col(f"{side}.word")
    return F.substring(word, F.col("i.a") + 1, F.length(word) - F.col("i.a") - F.col("i.b"))


def _links(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Verified links (u, v, u_n, v_n) of the words that meet under a key; u is the shorter or smaller word."""
    met = index.alias("i").join(probe.alias("p"), F.col("i.key") == F.col("p.key"))
    met = met.where((F.length("p.word") > F.col("i.l")) | (F.col("i.word") < F.col("p.word")))
    near = met.where(F.levenshtein(_middle("i"), _middle("p"), 1) == 1)
    return near.select(F.col("i.word").alias("u"), F.col("p.word").alias("v"), F.col("i.n").alias("u_n"), F.col("p.n").alias("v_n"))


def near_words(words: DataFrame, *, most_pairs: int = 20_000) -> DataFrame:
    """Distinct links (u, v, u_n, v_n) between words (word, n; stored, each word once) at exactly one inserted, deleted or
    replaced code point."""
    length = F.length("word")
    zero = F.lit(0).cast("int")
    start = words.where(length > 0).select(
        "word", "n", F.explode(F.array(F.struct(length.alias("l"), F.lit(True).alias("indexed")), F.struct(length.alias("l"), F.lit(False).alias("indexed")), F.struct((length - 1).alias("l"), F.lit(False).alias("indexed")))).alias("x")
    ).select("word", "n", "x.l", "x.indexed", zero.alias("a"), zero.alias("b")).where(F.col("l") > 0)
    found: list[DataFrame] = []
    while True:
        # a key that covers all but one code point can't be cut further
        ways = start.select("word", "n", "l", "indexed", _halves(F.col("l"), F.col("a"), F.col("b")).alias("w")).select("word", "n", "l", "indexed", "w.a", "w.b")
        rows = stored(_keyed(ways), "segments")
        sizes = rows.groupBy("key").agg(F.count_if("indexed").alias("_i"), F.count_if(~F.col("indexed")).alias("_p"), F.first(F.col("l") - F.col("a") - F.col("b")).alias("_rest"))
        hot = stored(sizes.where((F.col("_i") * F.col("_p") > most_pairs) & (F.col("_rest") > 1)).select("key"), "hot-segments")
        n_hot = hot.count()
        cold = rows.join(hot, "key", "left_anti") if n_hot else rows
        found.append(stored(_links(cold.where("indexed"), cold.where(~F.col("indexed"))), "links"))
        if not n_hot:
            break
        start = rows.join(hot, "key", "left_semi").select("word", "n", "l", "indexed", "a", "b")
    return reduce(DataFrame.union, found).distinct()


def forms(words: DataFrame, links: DataFrame, *, times: int = 5) -> DataFrame:
    """Each word with n_near and its form: the near word with the largest n (ties: the smallest), if that is `times` its own n at least."""
    other = lambda u, v: links.select(F.col(u).alias("_w"), F.struct((-F.col(f"{v}_n")).alias("m"), F.col(v).alias("word")).alias("o"))
    near = other("u", "v").union(other("v", "u")).groupBy("_w").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    rows = words.join(near, F.col("word") == F.col("_w"), "left")
    form_n = F.when(-F.col("o.m") >= times * F.col("n"), -F.col("o.m"))
    return rows.select("word", F.when(form_n.isNotNull(), F.col("o.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.cast("long").alias("form_n"))


def roots(rows: DataFrame) -> DataFrame:
    """rows (word, form; stored) with `root`: where following forms ends. Each round doubles the number of forms
    followed; counts grow along a chain, so there are few rounds."""
    now = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("_mid"), F.col("root").alias("_next"))
        joined = stored(now.join(after, F.col("root") == F.col("_mid"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    found = now.select(F.col("word").alias("_w"), "root")
    return rows.join(found, F.col("word") == F.col("_w"), "left").drop("_w").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, *, min_count: int = 5, times: int = 5, most_pairs: int = 20_000, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    words = stored(vocabulary(run_words(docs, **options), min_count), "vocabulary")
    rows = stored(forms(words, near_words(words, most_pairs=most_pairs), times=times), "forms")
    return roots(rows).select("word", "form", "root", "n", "n_near", "form_n")
