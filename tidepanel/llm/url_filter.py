"""URL filter: host and path rules, and gradient-boosted trees for all other URLs.

A rule fits its host and all subdomains of it if the URL's path starts with the
rule's path; the longest fitting rule decides. The URLs that a rule fits are the
labelled ones: the trees learn the rules' verdicts from lexical features of a
bounded sample of them (``SAMPLE``, least hashes first) and judge the rest.

Features: lengths of URL, host and path, depth, digit ratio, entropy of the
characters, numbers of parameters, labels, hyphens and dots, and statistics of
the host's suffix over all URLs (how many, mean depth, mean digit ratio, and the
share of labelled URLs that a rule blocks), and the same share for the first path
segment where it is a code of at most three letters (``de``, ``fr``). A URL that
teaches sees these shares without the URLs of its own fold, so no label reaches its
own features.

Scale: two passes over the URLs, one that sums the suffix statistics where the rows
lie and one that judges; the features of a URL never leave its row but to meet the
suffix table, which is joined in whatever way its measured size asks for. The
sample, at most ``SAMPLE`` rows of figures, is what the trees' training moves.

Cases: a null URL or one without ``://`` has empty host and path and no rule; A to Z
in the host become lower case, nothing else does; repeated rows stay; if the
labelled URLs all have one verdict, every other URL gets it, and ``allow`` if there
are none; an empty table gives an empty result; only the named columns are read.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SAMPLE = 20_000
TREES, DEPTH, FOLDS = 12, 4, 5
FEATURES = (
    "url_len",
    "host_len",
    "path_len",
    "depth",
    "digit_ratio",
    "entropy",
    "n_params",
    "n_labels",
    "n_hyphens",
    "has_fragment",
    "is_https",
    "suffix_len",
    "suffix_n",
    "suffix_depth",
    "suffix_digits",
    "suffix_blocked",
    "section_blocked"
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def judged(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, ruled``."""
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select(
        "*",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.select("*", rule.alias("rule"), verdict.alias("ruled"))


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` with the features that a URL has by itself, and its suffix."""
    u = F.coalesce("url", F.lit(""))
    characters = F.filter(F.split(u, ""), lambda c: c != "")
    n = F.length(u).cast("double")
    # Entropy from the lengths that remain when each distinct character goes.
    share = lambda c: (n - F.length(F.replace(u, c))) / n
    entropy = F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    suffix = F.substring_index("host", ".", -1)
    return rows.select(
        "*",
        suffix.alias("suffix"),
        F.regexp_extract("path", r"^/([a-z]{1,3})(?:/|$)", 1).alias("section"),
        F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold"),
        n.alias("url_len"),
        F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"),
        _count(F.col("path"), "/").alias("depth"),
        (_count(u, "0123456789") / F.greatest(n, F.lit(1.0))).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("n_params"),
        (_count(F.col("host"), ".") + 1).alias("n_labels"),
        _count(F.col("host"), "-").alias("n_hyphens"),
        F.contains(u, F.lit("#")).cast("double").alias("has_fragment"),
        F.lower(F.substring(u, 1, 6)).eqNullSafe("https:").cast("double").alias("is_https"),
        F.length(suffix).cast("double").alias("suffix_len"),
    )


_SUMS = ("n", "depths", "digits", "blocked", "known")


def suffix_sums(rows: DataFrame) -> DataFrame:
    """Sums over all URLs for each host suffix, section and fold."""
    return rows.groupBy("suffix", "section", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("depth").alias("depths"),
        F.sum("digit_ratio").alias("digits"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        F.count("ruled").alias("known"),
    )


def _with_statistics(rows: DataFrame, sums: DataFrame, out_of_fold: bool) -> DataFrame:
    """``rows`` with the figures of their suffixes; the shares of blocked URLs without the row's own fold, if asked for."""
    out = rows.join(sums.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in _SUMS]), "suffix", "left")
    shares = []
    for key in ("suffix", "section"):
        blocked, known = f"{key}_b", f"{key}_k"
        part = lambda *keys, end, key=key: sums.groupBy(key, *keys).agg(
            F.sum("blocked").alias(f"{key}_b{end}"),
            F.sum("known").alias(f"{key}_k{end}")
        )
        out = out.join(part(end=""), key, "left")
        b, k = F.coalesce(blocked, F.lit(0)), F.coalesce(known, F.lit(0))
        if out_of_fold:
            out = out.join(part("fold", end="_own"), [key, "fold"])
            b, k = b - F.col(f"{blocked}_own"), k - F.col(f"{known}_own")
        shares.append(((b + 0.5) / (k + 1)).alias(f"{key}_blocked"))
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.log1p(F.coalesce("all_n", F.lit(0))).alias("suffix_n"),
        (F.col("all_depths") / F.col("all_n")).alias("suffix_depth"),
        (F.col("all_digits") / F.col("all_n")).alias("suffix_digits"),
        *shares,
    )


def train(labelled: DataFrame, sums: DataFrame, sample: int = SAMPLE):
    """The trees, taught by at most ``sample`` of the rows that a rule decides; a constant where all have one verdict."""
    chosen = cut(labelled.filter("ruled IS NOT NULL").orderBy(F.xxhash64("url"), "page_id").limit(sample))
    taught = cut(_with_statistics(chosen, sums, True).withColumn("label", (F.col("ruled") == "block").cast("double")).select("label", *FEATURES))
    seen = sorted(r["label"] for r in taught.select("label").distinct().collect())
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(_assembler().transform(taught.coalesce(4)))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")


def with_probability(rows: DataFrame, sums: DataFrame, model) -> DataFrame:
    """``rows`` with the probability ``p_block`` that the trees give."""
    if isinstance(model, float):
        return rows.withColumn("p_block", F.lit(model))
    return model.transform(_assembler().transform(_with_statistics(rows, sums, False))).withColumn("p_block", vector_to_array("probability")[1])


def held_out_accuracy(df: DataFrame, key: str = "page_id", url: str = "url") -> tuple[float, float, int]:
    """Of the rule-labelled URLs of fold 0: the share that trees taught by the other folds judge rightly, the larger verdict's share, and how many."""
    rows = lexical(judged(df, key, url)).filter("ruled IS NOT NULL")
    others = rows.filter("fold <> 0")
    sums = cut(suffix_sums(others))
    tested = with_probability(rows.filter("fold = 0"), sums, train(others, sums)).select(
        (F.col("p_block") >= 0.5).alias("says"),
        (F.col("ruled") == "block").alias("is")
    )
    got = tested.agg(F.avg(F.expr("int(says = is)")), F.avg(F.col("is").cast("int")), F.count(F.lit(1))).first()
    return got[0], max(got[1], 1 - got[1]), got[2]


def url_report(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every URL, and the trees' ``p_block``, null where a rule decides."""
    rows = lexical(judged(df, key, url))
    sums = cut(suffix_sums(rows))
    out = with_probability(rows, sums, train(rows, sums))
    says = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", says).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("p_block")).alias("p_block")
    )
