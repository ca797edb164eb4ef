"""Secret scan: key-like strings judged by a random forest that removes false positives.

A candidate is a web token (three parts joined by dots), a value of 4 or more visible characters
assigned to a name that speaks of secrets, one of 8 or more assigned with ``=`` to any name, or a
run of 16 or more key characters. What the forest sees of it: length, digits, changes between kinds of characters,
distinct characters, how much of it dictionary words cover, whether it looks like a path or
stands in one, and the words and signs beside it. The forest is trained from labelled
findings: ``label_by_rule`` labels those whose form and neighbours leave little doubt, in the table itself
(the forest then judges all, also those without a label; a string in the published form of a
provider's key needs no judge and is a secret wherever it stands), or a table of reviewed findings is passed in.
``sample`` bounds the findings it is fitted on (smallest hashes); every candidate is judged.

Only DataFrame functions and Spark's own forest are used. A text is cut at its candidates once, so
a candidate's place and neighbours need no second search, and findings are explained row
by row; nothing is grouped, so no hot key arises. Whole texts are read.

Null, empty and candidate-free texts have no findings and are returned unchanged by
``redact``. Repeated rows have the same findings each. If the labelled findings lack one of
the classes there is nothing to learn from: rule labels decide then, and what has none is no secret.
An empty table gives an empty result. ``redact`` returns all columns of its input; its
own working columns take names that the input does not have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import unused

#: Names of secrets, without regard to case.
NAMES = r"token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credential|auth(?:orization)?|bearer"
_VALUE = r"[^\s\"'`<>]"
_SIGN = r"(?::=|=>|[=:])\s{0,2}[\"'`]?"
_END = r"(?<![,;.)\]}])"
#: What may be a secret. A value is found from the sign before it, which is rare, and only there is the name looked at; the
#: sign belongs to the match and is cut off again (``_LEAD``). All else starts at the string itself.
CANDIDATE = (
    r"eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]*)?"
    rf"|{_SIGN}(?<=(?i:{NAMES})[\"'`]?\s{{0,2}}{_SIGN}){_VALUE}{{4,}}{_END}"
    rf"|(?::=|=)\s{{0,2}}[\"'`]?(?<=[A-Za-z0-9_\"'`]\s{{0,2}}(?:=|:=)\s{{0,2}}[\"'`]?)(?![=>\s]){_VALUE}{{8,}}{_END}"
    r"|[A-Za-z0-9+/_\-]{16,}(?:==?(?=[,;.)\]}\"'`<>]|$)|==(?=\s))?")
_LEAD = f"^{_SIGN}"
#: Published forms of providers' keys.
KNOWN = (r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
         r"|[prs]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abeprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}"
         r"|eyJ[A-Za-z0-9_\-]{5,}\.eyJ[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]*)?)$")
LEFT, RIGHT = 64, 32
#: Words that stand beside a secret that is assigned, and beside numbers and digests that are none.
SECRET_WORDS = f"(?i)({NAMES})"
OTHER_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|revision|uuid|guid|isbn|card|iban|account|order|phone|tel|etag|version|hash)\W*$"
DICTIONARY = ("about", "account", "admin", "after", "app", "article", "background", "base", "blog", "class", "client", "color", "com",
              "config", "content", "copy", "data", "default", "demo", "div", "doc", "dummy", "edit", "en", "error", "example",
              "fake", "file", "font", "from", "get", "header", "home", "html", "http", "icon", "image", "img", "index", "info",
              "input", "item", "key", "lib", "link", "list", "local", "login", "main", "max", "menu", "min", "model", "name", "net",
              "new", "number", "object", "page", "param", "path", "placeholder", "post", "private", "public", "query", "request",
              "response", "sample", "search", "secret", "section", "server", "service", "set", "size", "source", "src",
              "start", "string", "style", "system", "table", "test", "text", "the", "time", "title", "token", "type", "update",
              "url", "user", "value", "version", "view", "web", "width", "with", "your")
FEATURES = ("length", "digits", "uppers", "switches", "distinct", "vowels", "covered", "hex", "slashes", "dashes", "path",
            "assigned", "quoted", "secret_word", "other_word", "left_letters")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, nth (from 0, among all runs of the text), candidate, left, right."""
    cut = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)).alias("_c"),
                      F.split(text_col, CANDIDATE, -1).alias("_p")).where(F.size("_c") > 0)
    each = cut.select("id", F.posexplode(F.zip_with(
        F.arrays_zip(F.col("_c").alias("c"), F.slice("_p", 1, F.size("_c")).alias("l")), F.slice("_p", 2, F.size("_c")),
        lambda x, r: F.struct(x["c"].alias("c"), F.right(x["l"], F.lit(LEFT)).alias("l"), F.left(r, F.lit(RIGHT)).alias("r")))).alias("nth", "x"))
    lead = F.regexp_extract("x.c", _LEAD, 0)
    return each.select("id", "nth", F.regexp_replace("x.c", _LEAD, "").alias("candidate"),
                       F.right(F.concat("x.l", lead), F.lit(LEFT)).alias("left"), F.col("x.r").alias("right"))


def _count(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES."""
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    n = F.length(c).cast("double")
    kinds = reduce(lambda s, p: F.regexp_replace(s, *p), (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[^0aA]", "-")), c)
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    tail = F.right(left, F.lit(24))
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return found.select(
        *found.columns, n.alias("length"), (_count(c, "[0-9]") / n).alias("digits"), (_count(c, "[A-Z]") / n).alias("uppers"),
        (F.length(runs) / n).alias("switches"), (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        (_count(F.lower(c), "[aeiou]") / n).alias("vowels"),
        (_count(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")") / n).alias("covered"),
        flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"), _count(c, "/").alias("slashes"), _count(c, "[\\-_]").alias("dashes"),
        flag(left.rlike(r"[/\\.~@]$") | right.rlike(r"^[/\\@]|^\.[A-Za-z]{1,4}\b")).alias("path"),
        flag(tail.rlike("[=:]\\s*[\"'`]?\\s*$")).alias("assigned"), flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).alias("quoted"),
        flag(tail.rlike(SECRET_WORDS)).alias("secret_word"), flag(left.rlike(OTHER_WORDS)).alias("other_word"),
        (_count(tail, r"\p{L}") / F.greatest(F.length(tail), F.lit(1))).alias("left_letters"))


def label_by_rule(found: DataFrame) -> DataFrame:
    """Findings with ``label`` (1.0 secret, 0.0 not) where form and neighbours leave little doubt, else null.

    Secret: a mixed or hexadecimal string assigned to a name that says so, a provider's key, and a bare string of
    digits, small and capital letters of high entropy. Not: digits only, few kinds of characters, mostly dictionary
    words, paths, words, and strings after a word that names a digest or a number. Other bare strings have no label.
    """
    c = F.col("candidate")
    mixed = (F.col("digits") > 0.05) & (F.col("digits") < 0.95) & (F.col("covered") < 0.4)
    signs = c.rlike("[^A-Za-z0-9+/_=.:\\-]") & c.rlike("[A-Za-z]") & ~c.contains("://") & (F.col("covered") < 0.4)
    secret = (F.col("secret_word") == 1) & (F.col("assigned") == 1) & (mixed | signs)
    entropy = (mixed & (F.col("length") >= 20) & c.rlike("[a-z]") & c.rlike("[A-Z]") & (F.col("slashes") < 3) & (F.col("dashes") < 3)
               & (F.col("switches") >= 0.5) & (F.col("distinct") >= 0.4) & (F.col("path") == 0))
    plain = (F.col("digits") >= 0.95) | (F.col("covered") >= 0.6) | (F.col("slashes") >= 3) | (F.col("distinct") < 0.2)
    word = c.rlike(r"^[A-Z]?[a-z]+(?:[\-_/.:][A-Za-z]?[a-z]+)*$") & (F.col("vowels") >= 0.2) & (F.col("assigned") == 0)
    other = (F.col("other_word") == 1) | ((plain | word) & (F.col("secret_word") == 0))
    return found.withColumn("label", F.when(c.rlike(KNOWN), 1.0).when(secret, 1.0).when(other, 0.0).when(entropy, 1.0))


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 7):
    """A random forest on labelled findings, or None where a class is missing."""
    rows = labelled.where("label is not null").select("label", *FEATURES)
    rows = rows.orderBy(F.xxhash64(*FEATURES), "label").limit(sample)
    path = scratch_path(labelled.sparkSession, "findings")
    rows.coalesce(1).write.parquet(path)
    rows = labelled.sparkSession.read.parquet(path)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)


def judged(found: DataFrame, model) -> DataFrame:
    """``found`` (with features and rule label) with score and is_secret."""
    if model is None:
        return found.withColumn("score", F.coalesce("label", F.lit(0.0))).withColumn("is_secret", F.col("score") >= 0.5)
    out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    return out.withColumn("score", F.when(F.col("candidate").rlike(KNOWN), 1.0).otherwise(vector_to_array("probability")[1])).withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, findings: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
         sample: int = 20_000) -> DataFrame:
    """Every candidate with its verdict: id, nth, candidate, left, right, score, is_secret.

    ``findings`` (candidate, left, right, label) are reviewed findings to learn from; without them
    the table's own findings are labelled by rule.
    """
    path = scratch_path(docs.sparkSession, "candidates")
    candidates(docs, id_col, text_col).write.parquet(path)
    found = label_by_rule(with_features(docs.sparkSession.read.parquet(path)))
    learned = with_features(findings.select("candidate", "left", "right", "label")) if findings is not None else found
    return judged(found, train(learned, sample)).select(
        F.col("id").alias(id_col), "nth", "candidate", "left", "right", "score", "is_secret")


def redact(docs: DataFrame, mark: str = "<SECRET>", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every string judged a secret replaced by ``mark``; all columns, all rows.

    Each row is redacted by the strings found in itself: rows are told apart by a digest of id and text.
    """
    own = unused(docs, "_secret_")
    row, hits = f"{own}row", f"{own}found"
    rows = docs.withColumn(row, F.xxhash64(id_col, text_col))
    bad = scan(rows, id_col=row, text_col=text_col, **options).where("is_secret").groupBy(row).agg(F.collect_set("candidate").alias(hits))
    both = rows.join(bad, row, "left")
    parts, runs = F.split(text_col, CANDIDATE, -1), F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))
    hidden = F.transform(runs, lambda c: F.when(
        F.array_contains(hits, F.regexp_replace(c, _LEAD, "")), F.concat(F.regexp_extract(c, _LEAD, 0), F.lit(mark))).otherwise(c))
    text = F.array_join(F.zip_with(parts, F.array_append(hidden, F.lit("")), lambda p, c: F.concat(p, c)), "")
    clean = F.when(F.col(hits).isNull(), F.col(text_col)).otherwise(text)
    return both.withColumn(text_col, clean).select(*docs.columns)
