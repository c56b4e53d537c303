"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators of high recall propose spans, which may overlap. Four of them are the base (email, ip, card, phone): their matches pass a fixed
test and always stay. The others propose further spans: secrets, numbers of identity papers and accounts, phone numbers without a plus
sign, spelled-out addresses. Boosted trees over features of a candidate's format and of the text before it give each of those a score;
a threshold for each kind, calibrated on held-out examples, selects them. An added span that overlaps a base span, or an added one
that begins earlier, is dropped.

The trees are trained on texts made here by a fixed rule (``examples``), whose candidates go through the same expressions, and are then
Spark expressions themselves. Positions: matches are marked by a private character and the text is split at it; starts are running sums
of the lengths of the pieces. Text is scanned once; what is shuffled is one narrow row for each piece.

Cases. Null and empty texts have no span. Positions count code points. Rows that repeat a doc_id keep a row each. A text that holds the
private character is searched with another in its place. Very long runs are matched without backtracking. Empty tables give no rows;
columns besides doc_id and text are not read. Base spans of different kinds may overlap, and all stay; of spans with one start the order
is that of ``KINDS``. n_email to n_phone count base spans, n_secret and n_id added ones, n_added all added ones, n_spans all.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.llm.common import documents
from pageline.llm.quality import _tree

MARK, INSTEAD = chr(0xE000), chr(0xE001)
KINDS = ("email", "ip", "card", "phone", "secret", "id")

#: Generators: name, kind, base or not, a cheap test whether a text can match at all, and the pattern. The first four are the base. Their
#: runs are possessive (they cannot give back) and begin where a run begins or the last match ended, which finds the same matches.
GENERATORS = (
    ("email", "email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", "card", True, r"[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("secret", "secret", False, r"[A-Za-z0-9+/_=-]{16}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"),
    ("paper", "id", False, r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account", "id", False, r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("local", "phone", False, r"[0-9][ .-]\(?[0-9]", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-]|\.[0-9])"),
    ("spelled", "email", False, r"(?i)[ (\[]at[ )\]]", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{2,40}(?:(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z0-9-]{2,20})+"),
)
FEATURES = ("generator", "length", "digits", "letters", "upper", "distinct", "hex", "marks", "assigned", "key_word", "phone_word", "id_word", "mail_word", "luhn")
TREES, SHRINK, EXAMPLES, SEED, PRECISION = 30, 0.3, 2400, 7, 0.98


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2))
    return (F.aggregate(at, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0) & (digits != "")


def _base_test(generator: Column, match: Column) -> Column:
    """The fixed test of each base kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits)
    return (
        F.when(generator == "email", True)
        .when(generator == "ip", part)
        .when(generator == "card", n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(generator == "phone", n.between(9, 15))
    )


def _piece(name: str):
    """A piece of a split text (p) that follows another (q): each second one is a match."""
    return lambda z, i: F.struct(
        F.lit(name).alias("generator"),
        i.alias("nth"),
        F.length(z["p"]).alias("length"),
        F.when(i % 2 == 1, z["p"]).alias("match"),
        F.when(i % 2 == 1, F.right(z["q"], F.lit(32))).alias("before"),
    )


def candidates(df: DataFrame) -> DataFrame:
    """row, doc_id, generator, match, before (up to 32 characters), start, end; rows without any match keep one row of nulls."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, INSTEAD)
    parts = []
    for name, _, _, likely, pattern in GENERATORS:
        likely_col = F.col("t").contains("@") if name == "email" else F.col("t").rlike(likely)
        pieces = F.split(F.regexp_replace(F.col("t"), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        told = F.transform(
            F.arrays_zip(pieces.alias("p"), F.concat(F.array(F.lit("")), pieces).alias("q")),
            _piece(name),
        )
        kind = "array<struct<generator:string,nth:int,length:int,match:string,before:string>>"
        parts.append(F.when(likely_col, told.cast(kind)).otherwise(F.array().cast(kind)))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    pieces = rows.select("row", "doc_id", F.explode_outer(F.concat(*parts)).alias("x")).select("row", "doc_id", "x.*")
    # pieces that no match follows or precedes tell nothing
    pieces = pieces.repartition("row")
    start = F.coalesce(F.sum("length").over(Window.partitionBy("row", "generator").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.col("length"))
    # the first piece of a generator stands for its document, so that no document is lost
    return placed.filter(F.col("match").isNotNull() | F.col("generator").isNull() | (F.col("nth") == 0))


def features() -> dict[str, Column]:
    """Format and context of a candidate, as expressions over generator, match and before."""
    m, before = F.col("match"), F.lower(F.col("before"))
    n = F.length(m).cast("double")

    def share(pattern: str) -> Column:
        return F.coalesce(1 - F.length(F.regexp_replace(m, pattern, "")) / n, F.lit(0.0))

    def says(pattern: str) -> Column:
        return F.coalesce(before.rlike(pattern), F.lit(False)).cast("double")

    number = F.lit(0.0)
    for k, g in enumerate(GENERATORS):
        number = F.when(F.col("generator") == g[0], F.lit(float(k))).otherwise(number)
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "generator": number,
        "length": n,
        "digits": share("[0-9]"),
        "letters": share("[A-Za-z]"),
        "upper": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(F.substring(m, 1, 64), ""))) / F.least(n, F.lit(64.0)),
        "hex": F.coalesce(m.rlike("^[0-9a-fA-F]+$"), F.lit(False)).cast("double"),
        "marks": share(r"[A-Za-z0-9]"),
        "assigned": says(r"""[=:]\s*["']?$"""),
        "key_word": says(r"(?:token|key|secret|passw|auth|credential)[a-z_ ]{0,8}\W{0,6}$"),
        "phone_word": says(r"(?:tel|phone|call|fax|mobile|cell)[a-z. ]{0,8}\W{0,6}$"),
        "id_word": says(r"(?:ssn|social|passport|iban|account|tax|id|no)[a-z. ]{0,10}\W{0,6}$"),
        "mail_word": says(r"(?:mail|contact|write|reach)[a-z. ]{0,10}\W{0,6}$"),
        "luhn": F.coalesce(_luhn(F.substring(digits, 1, 32)), F.lit(False)).cast("double"),
    }


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[int, str, int, int]]:
    """Texts made by a fixed rule: number, text, and where the personal data in it stands (-1, -1 where there is none)."""
    rng = random.Random(seed)
    hexes, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def of(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    def word() -> str:
        return of(letters[:26], rng.randint(2, 9))

    out = []
    for k in range(n):
        lead, tail = " ".join(word() for _ in range(rng.randint(2, 8))), " ".join(word() for _ in range(rng.randint(1, 5)))
        kind = rng.randrange(12)
        cue, good = "", True
        if kind < 3:
            span = of(hexes, rng.choice((20, 32, 40, 64))) if kind < 2 else of(letters + digits, rng.randint(20, 44))
            cue = rng.choice(("token = \"", "api_key: ", "secret=", "password: ", "auth token = \"", "", ""))
            good = bool(cue) or (kind < 2 and len(span) >= 32)
            span = span.upper() if rng.random() < 0.2 else span
            cue = cue.upper() if rng.random() < 0.2 else cue
        elif kind == 3:
            span, good = "-".join(word() + str(rng.randint(1, 99)) for _ in range(rng.randint(3, 6))), False
            cue = rng.choice(("", "see ", "page "))
        elif kind == 4:
            span, good = of(digits, rng.randint(16, 30)), False
            cue = rng.choice(("", "total ", "row "))
        elif kind == 5:
            span, cue = f"{of(digits, 3)}-{of(digits, 2)}-{of(digits, 4)}", rng.choice(("ssn ", "social security no. ", ""))
        elif kind == 6:
            span, cue = rng.choice("DFGEI") + rng.choice("ERBST") + of(digits, 2) + "".join(" " + of(digits, 4) for _ in range(4)), rng.choice(("IBAN ", "account ", ""))
        elif kind == 7:
            span, good = rng.choice("ABCX") + rng.choice("ZQKW") + of(digits, 2) + of("ABCDEF0123456789", 12), False
            cue = rng.choice(("part ", "model ", ""))
        elif kind < 10:
            span = f"({of(digits, 3)}) {of(digits, 3)}-{of(digits, 4)}" if kind == 8 else f"{of(digits, 3)}-{of(digits, 3)}-{of(digits, 4)}"
            cue = rng.choice(("call ", "phone: ", "tel. ", "", "fax "))
        elif kind == 10:
            span, good = f"{of(digits, rng.randint(2, 4))} {of(digits, rng.randint(3, 4))} {of(digits, rng.randint(3, 4))}", False
            cue = rng.choice(("", "sizes ", "rows "))
        else:
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", ".")))
            span, cue = f"{word()}.{word()}{at}{word()}{dot}com", rng.choice(("mail ", "contact ", ""))
        text = f"{lead} {cue}{span}" + ("\"" if cue.endswith('"') else "") + f" {tail}"
        start = len(lead) + 1 + len(cue)
        out.append((k, text, start if good else -1, start + len(span) if good else -1))
    return out


_TRAINED: list = []


class Model:
    """Boosted trees as nested choices, and the least score of each generator that is not of the base."""

    def __init__(self, x: np.ndarray, y: np.ndarray, train: np.ndarray):
        cuts = [np.unique(np.round(np.quantile(x[train, j], np.linspace(0, 1, 34)[1:-1]), 4)) for j in range(x.shape[1])]
        margin, self.trees = np.zeros(len(y)), []
        share = float(y[train].mean())
        self.base = float(np.log(share / (1 - share)))
        margin += self.base
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin[train]))
            step, paths = _tree(x[train], y[train] - p, p * (1 - p), cuts)
            leaves = []
            inner = {tuple(q[:k]) for q in paths for k in range(1, len(q))}
            for path in paths:
                if tuple(path) in inner:
                    continue
                rows = np.all([(x[train][:, j] > c) == above for j, above, c in path], axis=0)
                value = round(float(step[rows][0]) * SHRINK, 6) if rows.any() else 0.0
                leaves.append((path, value))
                margin[np.all([(x[:, j] > c) == above for j, above, c in path], axis=0)] += value
            self.trees.append(leaves)
        # the lowest score above which held-out candidates of a generator are precise enough
        self.least = {}
        for k, g in enumerate(GENERATORS):
            own = ~train & (x[:, 0] == k)
            if g[2] or not own.any():
                continue
            order = np.argsort(-margin[own], kind="stable")
            precise = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1) >= PRECISION
            last = np.flatnonzero(precise)
            self.least[g[0]] = round(float(margin[own][order][last[-1]]) - 1e-6, 6) if len(last) else float("inf")

    def selects(self, f: dict[str, Column]) -> Column:
        score = F.lit(self.base)
        for leaves in self.trees:
            tree = F.lit(0.0)
            for path, value in leaves:
                held = None
                for j, above, cut in path:
                    one = f[FEATURES[j]] > cut if above else f[FEATURES[j]] <= cut
                    held = one if held is None else held & one
                tree = F.when(held, F.lit(value)).otherwise(tree)
            score = score + tree
        chosen = F.lit(False)
        for name, least in self.least.items():
            if np.isfinite(least):
                chosen = F.when(F.col("generator") == name, score >= least).otherwise(chosen)
        return chosen


def train(spark: SparkSession) -> Model:
    """The model from ``EXAMPLES`` made texts; two thirds train, one third calibrates."""
    made = examples()
    df = spark.createDataFrame(made, "doc_id long, text string, good_start long, good_end long")
    found = candidates(df.select("doc_id", "text")).filter("match is not null").join(df.select("doc_id", "good_start", "good_end"), "doc_id")
    hit = (F.col("start") < F.col("good_end")) & (F.col("good_start") < F.col("end"))
    rows = found.select("doc_id", "start", hit.cast("double").alias("y"), *(c.alias(k) for k, c in features().items())).toPandas().sort_values(["doc_id", "generator", "start"])
    return Model(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), rows["doc_id"].to_numpy() % 3 != 0)


def trained(spark: SparkSession) -> Model:
    """The model, trained once in a process: its examples are fixed, so it is always the same one."""
    if not _TRAINED:
        _TRAINED.append(train(spark))
    return _TRAINED[0]


def find_spans(df: DataFrame, model: Model | None = None) -> DataFrame:
    """row, doc_id, kind, start, end, is_base of every span; a document without any keeps one row of nulls."""
    model = model or trained(df.sparkSession)
    found = candidates(df)
    kind, base = F.lit(None).cast("string"), F.lit(False)
    for name, of, is_base, _, _ in GENERATORS:
        kind = F.when(F.col("generator") == name, F.lit(of)).otherwise(kind)
        base = F.when(F.col("generator") == name, F.lit(is_base)).otherwise(base)
    found = found.withColumn("kind", kind).withColumn("is_base", base)
    found = found.withColumn("f", F.struct(*(c.alias(k) for k, c in features().items())))
    stays = F.when(F.col("match").isNull(), False).when(F.col("is_base"), _base_test(F.col("generator"), F.col("match"))).otherwise(model.selects({k: F.col(f"f.{k}") for k in FEATURES}))
    found = found.withColumn("stays", F.coalesce(stays, F.lit(False))).select("row", "doc_id", "kind", "start", "end", "is_base", "stays")
    order = Window.partitionBy("row").orderBy("start", F.desc("is_base"), "end", "kind")
    held = F.col("stays") & F.col("is_base")
    found = found.withColumns(
        {
            "base_end": F.max(F.when(held, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "base_start": F.min(F.when(held, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)),
            "more_end": F.max(F.when(F.col("stays") & ~F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end")) & (F.coalesce("more_end", F.lit(0)) <= F.col("start"))
    return found.withColumn("stays", F.col("stays") & (F.col("is_base") | free)).select("row", "doc_id", "kind", "start", "end", "is_base", "stays")


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every whole text."""
    spans = find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    rank = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        rank = F.when(F.col("kind") == name, F.lit(k)).otherwise(rank)
    told = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("told"))
    base = F.col("stays") & F.col("is_base")

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, told))), lambda x: x["told"]), ",")

    counts = [F.count_if(base & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS[:4]]
    added = F.col("stays") & ~F.col("is_base")
    more = [F.count_if(added & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS[4:]] + [F.count_if(added).alias("n_added"), F.count_if(F.col("stays")).alias("n_spans")]
    out = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("stays")).alias("spans"), *more)
    return out.drop("row")
