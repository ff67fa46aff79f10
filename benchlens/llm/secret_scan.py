"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

Candidates are cut out of a text by one pattern and stay in its row, between
the gaps around them. Each gets features of its length, character transitions,
dictionary coverage, path and neighbouring words; a forest trained on labelled
findings is compiled to a column expression over them, so scanning and redacting need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchlens.llm.subwords import sample

# Shapes and words that credentials are known by.
ASSIGNED = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
KNOWN = "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}"
_KEY = r"[A-Za-z0-9+/_\-]"
_VALUE = r"[^\s\"',;]"
# an assigned name from the start of its run of key characters, up to a value (which is not part of it)
ASSIGNMENT = rf"(?i:{_KEY}*?(?:{ASSIGNED})[\"']?[ \t]*[=:][ \t]*[\"']?)(?={_VALUE}{{6}})"
# an assigned value, or a long run of key characters; both are only tried from the start of a run
CANDIDATE = rf"(?<!{_KEY})(?:{ASSIGNMENT}{_VALUE}+|{_KEY}{{16,}}={{0,2}})"
BENIGN = "sha-?(?:1|256|512)?|md5|checksum|digest|commit|revision|uuid|guid|isbn|example|sample|dummy|placeholder|test"
# Frequent letter pairs and words of English, German, French and Spanish.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ge|un|qu|ue|ai"
WORDS = ("the|and|tion|ing|that|with|from|this|have|ment|for|was|are|not|you|all|ent|est|able|ness|less|ous|ship|over|under|inter|"
         "ung|heit|keit|lich|sch|ein|und|der|die|das|nicht|eau|elle|ique|pour|dans|ction|que|ado|ciento|mente|para|los|las|con|una|"
         "pass|word|user|name|file|data|time|test|null|true|false|class|type|value|string|index|error|key|id")
PER_LABEL = 3000  # labelled findings of each label that a forest is trained on
FEATURES = ("length", "digits", "capitals", "changes", "distinct", "pairs", "words", "hex", "known", "keyword", "assigned",
            "quoted", "benign", "test_path", "key_path")


def _share(count: Column, size: Column) -> Column:
    return count / F.greatest(size, F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The features of ``FEATURES``, in order, as doubles."""
    n = F.length(value)
    low = F.lower(value)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    flag = lambda c, pattern: F.regexp_like(c, F.lit(pattern))
    got = [
        n,
        _share(count(value, "[0-9]"), n),
        _share(count(value, "[A-Z]"), n),
        _share(count(value, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), n),
        _share(F.size(F.array_distinct(F.split(value, ""))), n),
        _share(count(low, f"(?={PAIRS})"), n),
        _share(n - F.length(F.regexp_replace(low, F.lit(WORDS), F.lit(""))), n),
        flag(value, r"\A[0-9a-fA-F]+\z"),
        flag(value, rf"\A(?:{KNOWN})"),
        flag(before, rf"(?i)(?:{ASSIGNED})"),
        flag(before, rf"(?i)(?:{ASSIGNED})[\"']?\s*[=:]\s*[\"']?\z"),
        flag(before, r"[\"']\z") & flag(after, r"\A[\"']"),
        flag(before, rf"(?i)\b(?:{BENIGN})\b"),
        flag(path, r"(?i)(?:^|[/._-])(?:tests?|examples?|docs?|fixtures?|mocks?)(?:[/._-]|$)"),
        flag(path, r"(?i)\.(?:env|pem|key|cfg|conf|ini|ya?ml|properties)$"),
    ]
    return [c.cast("double") for c in got]


def with_candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with ``_gaps`` (texts around candidates) and ``_found`` (candidates with context and features)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    cut = docs.withColumn("_hits", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    # texts without a candidate are not cut; an assignment's name belongs to the gap before its value
    name = lambda hit: F.coalesce(F.regexp_extract(hit, rf"\A{ASSIGNMENT}", 0), F.lit(""))
    cut = cut.withColumn("_gaps", F.when(F.size("_hits") > 0, F.zip_with(
        F.split(text, CANDIDATE, -1), "_hits", lambda gap, hit: F.concat(gap, name(hit)))).otherwise(F.array(text)))
    cut = cut.withColumn("_values", F.transform("_hits", lambda hit: F.substr(hit, F.length(name(hit)) + 1))).drop("_hits")
    near = F.transform("_values", lambda v, i: F.struct(
        v.alias("value"), F.right(F.get("_gaps", i), F.lit(40)).alias("before"), F.left(F.get("_gaps", i + 1), F.lit(8)).alias("after")))
    cut = cut.withColumn("_near", near)

    def described(x: Column) -> Column:
        own = features(x["value"], x["before"], x["after"], path)
        return F.struct(x["value"].alias("value"), x["before"].alias("before"),
                        *[c.alias(f) for f, c in zip(FEATURES, own)])

    return cut.withColumn("_found", F.transform("_near", described)).drop("_values", "_near")


@dataclass
class Forest:
    """Trees as nested tuples: (feature, threshold, left, right) or the leaf's share of secrets."""

    trees: list

    def score(self, feature: Callable[[str], Column]) -> Column:
        """Average over the trees of the share of secrets in the leaf that a finding falls into."""
        def walk(node: tuple | float) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, limit, left, right = node
            return F.when(feature(FEATURES[at]) <= limit, walk(left)).otherwise(walk(right))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / len(self.trees)


def train(findings: DataFrame, trees: int = 20, depth: int = 5, seed: int = 1, per_label: int = PER_LABEL) -> Forest:
    """Forest from labelled findings: the columns of ``FEATURES`` and ``label`` (1: a secret, 0: none, null: left out).

    About ``per_label`` different findings of each label are fitted, chosen by a hash.
    With one label value only, the forest is a single leaf of that value;
    without labelled findings it says 0.
    """
    spark = findings.sparkSession
    known = findings.where("label in (0, 1)").select(*FEATURES, F.col("label").cast("double").alias("label")).distinct()
    rows = sample(known, "label", F.xxhash64(*FEATURES), per_label).select(*FEATURES, "label").collect()
    labels = {r["label"] for r in rows}
    if len(labels) < 2:
        return Forest([next(iter(labels), 0.0)])
    # a bounded local table in a fixed order: the same rows always grow the same forest
    table = spark.createDataFrame(sorted(rows), findings.select(*FEATURES).schema.add("label", "double")).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(table)

    def node(n) -> tuple | float:
        if n.subtreeDepth() == 0:
            none, secret = (float(x) for x in n.impurityStats().stats())
            return secret / (none + secret)
        return (n.split().featureIndex(), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild()))

    return Forest([node(t._call_java("rootNode")) for t in model.trees])


def own_labels(found: DataFrame) -> DataFrame:
    """Labels that the candidates' shapes give by themselves (for tables without labelled findings).

    A value of a known key shape, or one with a digit that is assigned to a
    credential's name, is a secret; one of letters only or of digits only that
    is not assigned is none; all others have no label.
    """
    v = F.col("value")
    digit, one_kind = v.rlike("[0-9]"), v.rlike(r"\A(?:[A-Za-z/_\-]+|[0-9]+)\z")
    return found.withColumn("label", F.when((F.col("known") > 0) | ((F.col("assigned") > 0) & digit), 1)
                            .when(one_kind & (F.col("assigned") == 0), 0))


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row for each candidate: value, before and the features."""
    cut = with_candidates(docs.select(text_col, *([path_col] if path_col else [])), text_col, path_col)
    # explode would have texts filtered by their number of candidates first, and so cut twice
    return cut.select(F.explode_outer("_found").alias("f")).where(F.col("f").isNotNull()).select("f.*")


def with_scores(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with ``_gaps`` and ``_scored``: (value, score) of every candidate, in order."""
    cut = with_candidates(docs, text_col, path_col)
    return cut.withColumn("_scored", F.transform("_found", lambda x: F.struct(
        x["value"].alias("value"), forest.score(lambda f: x[f]).alias("score")))).drop("_found")


def scan(docs: DataFrame, forest: Forest, keep: list[str], text_col: str = "text", path_col: str | None = None,
         at_least: float = 0.5) -> DataFrame:
    """Every candidate of every whole text: ``keep`` columns, start, value, score, is_secret.

    ``start`` counts code points from 0. Null and empty texts have no
    candidates; repeated rows are scanned each; null ids are kept; an empty
    table gives an empty result. ``keep`` must not hold the new names.
    """
    src = docs.select(*keep, *{c for c in (text_col, path_col) if c and c not in keep})
    # no filter on the candidates' number here: it would be pushed below them and cut every text once more
    found = F.zip_with("_gaps", "_scored", lambda g, s: F.struct(F.length(g).alias("gap"), s.alias("s")))
    got = with_scores(src, forest, text_col, path_col).withColumn("_row", F.monotonically_increasing_id()).select(
        *keep, "_row", F.posexplode(F.filter(found, lambda c: c["s"].isNotNull())).alias("_at", "_c"))
    # a text's candidates are added up in its own order; texts and gaps are not moved
    rows = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_c.gap") + F.length("_c.s.value")).over(rows), F.lit(0))
    return got.withColumn("start", (before + F.col("_c.gap")).cast("long")).select(
        *keep, "start", F.col("_c.s.value").alias("value"), F.col("_c.s.score").alias("score"),
        (F.col("_c.s.score") >= at_least).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, at_least: float = 0.5,
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; all other texts stay as they are.

    A null text stays null; columns and rows are unchanged otherwise.
    """
    names = docs.columns
    got = with_scores(docs, forest, text_col, path_col)
    hit = F.exists("_scored", lambda s: s["score"] >= at_least)
    new = F.array_join(F.zip_with("_gaps", "_scored", lambda g, s: F.concat(
        g, F.when(s["score"] >= at_least, F.lit(mark)).otherwise(F.coalesce(s["value"], F.lit(""))))), "")
    return got.withColumn(text_col, F.when(hit, new).otherwise(F.col(text_col))).select(*names)
