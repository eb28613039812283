"""Personal data in texts: exact base rules, and boosted trees over further candidates. DataFrame functions only.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns that pass their
check. The patterns below match the same strings as the plain ones but never try a run of characters twice, so
long texts take linear time: atoms are possessive, and a run is entered at its start only.

Beyond them, generators with high recall propose overlapping spans of three kinds: ``secret`` (long tokens with letters and digits, also
with ``_``, ``-`` and dots, and whatever stands behind password, token and the like), ``number`` (groups of digits: local phones, ids) and ``account``
(letters and digits grouped like an international account number). Boosted trees score every candidate by its
format (length, shares of digits, capitals and vowels, changes between letters and digits, different characters, separators) and its context
(the characters before it: words that announce a credential or a number, words that announce something ordinary), the same in training and in use.

Labels come from what rules can prove about candidates of the corpus (announced values, account check digits, dates, file names), and from SEEDS: forms
of private and ordinary strings, filled with pseudo-random characters, since a corpus may hold few labelled ones. Other candidates are
unlabelled. Training uses about SAMPLE distinct labelled candidates at most, shared out over kinds and labels; all others set a threshold for each kind: the
least score from which at least PRECISION of that kind are private. Of overlapping candidates above their thresholds the one farthest
above stays; those that touch a base span go. Everything but the sample runs over all texts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import stored

KINDS = ["email", "ip", "card", "phone", "secret", "number", "account"]
PROPOSED = KINDS[4:]
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: name -> (kind, pattern). Words that announce a value.
WORDS = "password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key"
GENERATORS = {
    "token": ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9][A-Za-z0-9_+/=-]{10,}+(?:\.[A-Za-z0-9_+/=-]{4,}+)*+"),
    "value": ("secret", rf"(?<=(?i:{WORDS})[\"']{{0,1}} {{0,1}}[:=] {{0,1}}[\"']{{0,1}})[^\s\"',;:=]{{6,}}+"),
    "number": ("number", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,6}\)?(?:[ ./-]\(?[0-9]{2,6}\)?){1,5}+(?![0-9A-Za-z])"),
    "account": ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"),
}
#: Forms of credentials and of ordinary strings, and words in front of a candidate (fixed values).
CREDENTIAL = r"^(?:AKIA|ASIA)[0-9A-Z]{12,}$"
ANNOUNCED = rf"(?i)(?:{WORDS}|bearer|authorization)[\"' ]*[=:]?[\"' ]*$"
CALLED = r"(?i)(?:telephone|tel|phone|call|fax|mobile|cell|dial|ssn|passport|iban|account|konto)[. ]{0,2}(?:no|nr|number)?[.:]{0,2} ?\(?$"
ORDINARY = r"(?i)(?:commit|build|version|release|revision|sha[0-9]*|md5|file|image|img|isbn|issn|pages?|order|model|item|date|dated|since|until|between|score|chapter|section|part|copyright|\(c\))[.:# ]{0,2}$"
PLAIN_TOKEN = r"^[0-9._/+=-]+$|^[A-Za-z]+(?:[-_/.][A-Za-z]+)+(?:[-_/.]?[0-9]{1,4})?$|\.(?:jpe?g|png|gif|pdf|html?|txt|csv|json|zip|gz|py|js)$"
PLAIN_NUMBER = r"^(?:19|20)[0-9]{2}[-/. ][0-9]{2}(?:[-/. ][0-9]{2,4})?$|^[0-9]{2}[-/. ][0-9]{2}[-/. ](?:19|20)[0-9]{2}$|^(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)?[0-9]{2}$"
SAMPLE, PRECISION = 20_000, 0.95
TREES, DEPTH = 16, 4
#: Characters in front of a candidate that count as its context, and seeds of each form.
CONTEXT, SEEDED = 24, 120
BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of all earlier entries, for each entry; in blocks, so that long arrays don't cost their square."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(lengths, b + 1, F.lit(BLOCK)))
    zero = F.array(F.lit(0))
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    before = F.aggregate(totals, zero, add)
    return F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(before, i + 1)), add), 1, F.size(b))))


def once(c: Column) -> Column:
    """The same value, computed once a row: an expression that is not deterministic is never copied into the ones that use it, as Catalyst does
    with others, here into lambdas that would then split a text anew for each of its matches."""
    return F.when(F.rand(0) >= 0, c)


def found(df: DataFrame, text: str, kind: str, pattern: str, worth: Column) -> DataFrame:
    """Adds ``_<kind>``: (start, end, match, before) of all matches, in code points; empty where ``worth`` is false. ``before`` is the text
    in front, CONTEXT characters at most and none of an earlier match."""
    matches, pieces, gaps, sums, starts, name = f"_m_{kind}", f"_p_{kind}", f"_g_{kind}", f"_s_{kind}", f"_a_{kind}", f"_{kind}"
    some = lambda c, kind: F.when(F.size(matches) > 0, c).otherwise(F.array().cast(kind))
    df = df.withColumn(matches, once(F.when(worth, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))))
    # The text in front of each match; what follows the last one is left out.
    df = df.withColumn(pieces, once(some(F.slice(F.split(F.col(text), pattern, -1), 1, F.size(matches)), "array<string>")))
    df = df.withColumn(gaps, once(F.zip_with(pieces, matches, lambda p, m: F.char_length(p) + F.char_length(m))))
    df = df.withColumn(sums, once(some(running(F.col(gaps)), "array<int>")))
    df = df.withColumn(starts, once(F.zip_with(sums, pieces, lambda front, p: front + F.char_length(p))))
    tails = F.transform(pieces, lambda p: F.substring(p, -CONTEXT, CONTEXT)).alias("before")

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["match"])).alias("end"), x["match"].alias("match"), x["before"].alias("before"))

    zipped = F.arrays_zip(F.col(starts).alias("start"), F.col(matches).alias("match"), tails)
    return df.withColumn(name, once(F.transform(zipped, span))).drop(matches, pieces, gaps, sums, starts)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(F.concat(p, F.lit("x")), F.lit("0")))
        return F.forall(parts, lambda p: F.when(F.char_length(p) <= 4, F.coalesce(F.regexp_extract(p, "^([0-9]*)x", 1).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_base`` (valid matches of the base kinds as start, kind number, end) and ``_token`` ... ``_account`` (what the generators propose)."""
    df = df.withColumn("_digit", F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False)))
    worth = {
        "email": F.contains(F.col(text), F.lit("@")), "ip": F.col("_digit") & F.contains(F.col(text), F.lit(".")),
        "card": F.col("_digit"), "phone": F.col("_digit") & F.contains(F.col(text), F.lit("+")),
    }
    parts = []
    for number, kind in enumerate(KINDS[:4]):
        df = found(df, text, kind, PATTERNS[kind], F.coalesce(worth[kind], F.lit(False)))
        ok = F.filter(f"_{kind}", lambda s: valid(kind, s["match"]))
        parts.append(F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))))
    df = df.withColumn("_base", F.array_sort(F.concat(*parts)))
    worth = {
        "token": F.col("_digit"), "value": F.col(text).rlike(rf"(?i)(?:{WORDS})[\"']? ?[:=]"), "number": F.col("_digit"),
        "account": F.col("_digit") & F.col(text).rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    }
    for name, (_, pattern) in GENERATORS.items():
        df = found(df, text, name, pattern, F.coalesce(worth[name], F.lit(False)))
    mixed_tokens = F.filter("_token", lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    return df.withColumn("_token", mixed_tokens).drop(*[f"_{kind}" for kind in KINDS[:4]])


FEATURES = ["length", "digits", "capitals", "vowels", "changes", "different", "hyphens", "marks", "blanks", "hex", "quoted", "announced", "called", "ordinary", "plain", "kind_no"]


def features(m: Column, before: Column, kind: str) -> dict[str, Column]:
    """Format and context of a candidate; ``before`` holds up to CONTEXT characters in front of it."""
    n = F.greatest(F.char_length(m), F.lit(1)).cast("double")
    share = lambda pattern: F.char_length(F.regexp_replace(m, pattern, "")) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    return {
        "length": F.least(n, F.lit(100.0)), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "vowels": share("[^aeiouAEIOU]"),
        "changes": F.char_length(F.regexp_replace(classes, "[^9aA]", "")) / n, "different": F.size(F.array_distinct(F.split(m, ""))) / F.least(n, F.lit(40.0)),
        "hyphens": share("[^_-]") * n, "marks": share("[^./+=]") * n, "blanks": share("[^ ()]") * n, "hex": flag(m.rlike("^[0-9a-f]+$")),
        "quoted": flag(before.rlike("[=:\"']$")), "announced": flag(before.rlike(ANNOUNCED)), "called": flag(before.rlike(CALLED)), "ordinary": flag(before.rlike(ORDINARY)),
        "plain": flag(m.rlike(PLAIN_NUMBER if kind == "number" else PLAIN_TOKEN)), "kind_no": F.lit(float(KINDS.index(kind))),
    }


def checked_account(match: Column) -> Column:
    """Whether the check digits of an account number hold: its first four characters at the end, letters as numbers, rest 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def digest(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(value < 10, rest * 10 + value).otherwise(rest * 100 + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(digest(rest, c))) == 1


def proved(kind: str, m: Column, before: Column) -> Column:
    """1 where a rule can prove that a candidate is private, 0 where it is not, else null."""
    if kind == "account":
        return F.when(checked_account(m), 1.0).otherwise(0.0)
    if kind == "number":
        return F.when(m.rlike(PLAIN_NUMBER) | before.rlike(ORDINARY), 0.0).when(before.rlike(CALLED), 1.0)
    return F.when(before.rlike(ORDINARY), 0.0).when(m.rlike(CREDENTIAL) | before.rlike(ANNOUNCED), 1.0).when(m.rlike(PLAIN_TOKEN), 0.0)


def _described(kind: str, label: Column, m: Column, before: Column) -> Column:
    f = features(m, before, kind)
    return F.struct(F.lit(kind).alias("kind"), label.cast("double").alias("label"), F.xxhash64(m, before).alias("draw"), *[f[c].cast("double").alias(c) for c in FEATURES])


def candidates(df: DataFrame, text: str) -> DataFrame:
    """One row per labelled candidate of any kind: kind, label, draw (a hash of match and context) and features."""
    def one(kind: str):
        return lambda s: _described(kind, proved(kind, s["match"], s["before"]), s["match"], s["before"])

    made = [F.transform(f"_{name}", one(kind)) for name, (kind, _) in GENERATORS.items()]
    return df.select(once(F.concat(*made)).alias("_c")).select(F.explode("_c").alias("c")).select("c.*").where(F.col("label").isNotNull())


#: Characters that stand for a pseudo-random one in a seed's form.
NOISE = {"hex": "\ue000", "digits": "\ue001", "letters": "\ue002", "mixed": "\ue003", "capitals": "\ue004"}

#: Seeds as label, kind, text in front, and parts: plain text or (alphabet, length).
SEEDS = [
    (1, "secret", "api_key = ", [("mixed", 32)]), (1, "secret", "secret: ", [("mixed", 24)]), (1, "secret", "password=", [("hex", 18)]), (1, "secret", 'token = "', [("hex", 40)]),
    (1, "secret", "password: ", [("letters", 10)]), (1, "secret", "passwd: ", [("letters", 7), ("digits", 3)]), (1, "secret", "it says ", ["AKIA", ("capitals", 16)]), (1, "secret", "the key ", [("mixed", 40)]),
    (1, "secret", "we used ", [("letters", 2), "_", ("mixed", 32)]), (1, "secret", "then ", [("letters", 3), "_", ("letters", 4), "_", ("mixed", 24)]), (1, "secret", "from ", [("letters", 4), "-", ("digits", 11), "-", ("digits", 12), "-", ("mixed", 24)]),
    (1, "secret", "header ", [("mixed", 20), ".", ("mixed", 44), ".", ("mixed", 43)]), (1, "secret", "it was ", [("mixed", 22), "=="]), (1, "secret", "with ", [("letters", 3), "-", ("mixed", 40)]),
    (0, "secret", "commit ", [("hex", 40)]), (0, "secret", "in commit ", [("hex", 10)]), (0, "secret", "build ", [("digits", 8), "-rc", ("digits", 1)]), (0, "secret", "version ", ["2.", ("digits", 2), ".", ("digits", 4), "-beta", ("digits", 1)]),
    (0, "secret", "see IMG_", [("digits", 8), "_", ("digits", 6), ".jpg"]), (0, "secret", "the ", ["report-", ("digits", 4), "-final.pdf"]), (0, "secret", "an ", [("letters", 7), "-", ("letters", 9), "-", ("digits", 4)]),
    (0, "secret", "order ", [("capitals", 2), ("digits", 10)]), (0, "secret", "sha256 ", [("hex", 64)]), (0, "secret", "the ", [("letters", 9), ("digits", 4)]), (0, "secret", "and ", [("letters", 6), "/", ("letters", 8), "/", ("digits", 3)]),
    (0, "secret", "the ", [("hex", 8), "-", ("hex", 4), "-", ("hex", 4), "-", ("hex", 4), "-", ("hex", 12)]), (0, "secret", "of ", ["page", ("digits", 3), "_item", ("digits", 4)]), (0, "secret", "the ", [("letters", 12), ("digits", 2)]),
    (1, "number", "call ", ["0", ("digits", 3), " ", ("digits", 3), " ", ("digits", 4)]), (1, "number", "tel. ", ["(0", ("digits", 2), ") ", ("digits", 4), "-", ("digits", 4)]), (1, "number", "phone ", ["0", ("digits", 2), "/", ("digits", 6)]),
    (1, "number", "reach me at ", ["(", ("digits", 3), ") ", ("digits", 3), "-", ("digits", 4)]), (1, "number", "her ssn ", [("digits", 3), "-", ("digits", 2), "-", ("digits", 4)]), (1, "number", "me on ", ["0", ("digits", 4), " ", ("digits", 6)]),
    (1, "number", "under ", ["0", ("digits", 2), " ", ("digits", 3), " ", ("digits", 2), " ", ("digits", 2)]), (1, "number", "is ", [("digits", 3), "-", ("digits", 3), "-", ("digits", 4)]),
    (0, "number", "on ", ["20", ("digits", 2), "-11-", "0", ("digits", 1)]), (0, "number", "from ", ["19", ("digits", 2), "-20", ("digits", 2)]), (0, "number", "pages ", [("digits", 2), "-", ("digits", 3)]), (0, "number", "isbn ", ["978-", ("digits", 2), "-", ("digits", 5), "-", ("digits", 2)]),
    (0, "number", "about ", [("digits", 2), " ", ("digits", 3)]), (0, "number", "about ", [("digits", 2), ".", ("digits", 2)]), (0, "number", "the ", [("digits", 2), "/", ("digits", 2)]), (0, "number", "version ", ["10.", ("digits", 2), ".", ("digits", 2)]),
    (0, "number", "about ", [("digits", 3), " ", ("digits", 3), " ", ("digits", 3)]), (0, "number", "on ", ["12/", "11/20", ("digits", 2)]), (0, "number", "rows ", [("digits", 2), " ", ("digits", 2), " ", ("digits", 2)]), (0, "number", "is ", [("digits", 4), ".", ("digits", 2)]),
    (1, "account", "iban ", ["DE", ("digits", 2), " ", ("digits", 4), " ", ("digits", 4), " ", ("digits", 4), " ", ("digits", 4), " ", ("digits", 2)]), (1, "account", "to ", ["FR", ("digits", 25)]), (1, "account", "account ", ["GB", ("digits", 2), "ABCD", ("digits", 14)]),
    (1, "account", "pay ", ["NL", ("digits", 2), " ", "BANK", " ", ("digits", 4), " ", ("digits", 4), " ", ("digits", 2)]),
    (0, "account", "part ", [("capitals", 2), ("digits", 2), " ", ("capitals", 4), " ", ("capitals", 4)]), (0, "account", "the ", [("capitals", 2), ("digits", 2), "MODEL", ("capitals", 3), ("digits", 3)]), (0, "account", "order ", ["AB", ("digits", 2), ("digits", 8)]),
]


def seeds(spark: SparkSession) -> DataFrame:
    """Labelled candidates of every form in SEEDS, with other characters in each of SEEDED rows."""
    forms = [(float(label), kind, front, "".join(x if isinstance(x, str) else NOISE[x[0]] * x[1] for x in parts)) for label, kind, front, parts in SEEDS]
    rows = spark.createDataFrame([(k, *f) for k, f in enumerate(forms)], "form int, label double, kind string, front string, text string")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(SEEDED))))
    rows = rows.withColumn("hex", F.concat(*[F.sha2(F.concat_ws(".", "form", "copy", F.lit(k)), 512) for k in range(2)]))
    mixed = F.translate(F.base64(F.unhex(F.concat("hex", F.reverse("hex")))), "+/=\r\n", "kQ")
    rows = rows.withColumn("mixed", mixed).withColumns({"digits": F.translate("hex", "abcdef", "274951"), "letters": F.translate(F.lower("mixed"), "0123456789", "aeioulmnrs"), "capitals": F.upper("mixed")})

    def filled(c: Column, i: Column) -> Column:
        out = c
        for name, mark in NOISE.items():
            out = F.when(c == mark, F.substr(F.col(name), i + 1, F.lit(1))).otherwise(out)
        return out

    value = F.array_join(F.transform(F.split("text", ""), filled), "")
    opening = F.element_at(F.array(F.lit("and so "), F.lit("text. "), F.lit(""), F.lit("who knows ")), F.col("copy") % 4 + 1)
    rows = stored(rows.select("label", "kind", value.alias("m"), F.substring(F.concat(opening, "front"), -CONTEXT, CONTEXT).alias("before")))
    made = [rows.where(F.col("kind") == kind).select(_described(kind, F.col("label"), F.col("m"), F.col("before")).alias("c")).select("c.*") for kind in PROPOSED]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _scored(trees: list[tuple[float, object]], values: dict[str, Column]) -> Column:
    """The margin of all trees as one expression of the feature columns."""

    def tree(node, values: dict[str, Column]) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(values[name] <= threshold, tree(left, values)).otherwise(tree(right, values))

    total = F.lit(0.0)
    for weight, node in trees:
        total = total + F.lit(weight) * tree(node, values)
    return total


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


class Model:
    """Boosted trees as expressions, and the margin of each kind from which a candidate is redacted (a kind without one: none is)."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def excess(self, kind: str, values: dict[str, Column]) -> Column:
        """How far a candidate lies above its kind's threshold."""
        if kind not in self.thresholds:
            return F.lit(-1.0)
        return _scored(self.trees, values) - F.lit(self.thresholds[kind])


def shared_out(sizes: list[int], total: int) -> list[int]:
    """Equal quotas of ``total``, none above its size; what small ones leave goes to the others."""
    quotas, left = [0] * len(sizes), total
    for rank, k in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        quotas[k] = min(sizes[k], left // (len(sizes) - rank))
        left -= quotas[k]
    return quotas


def fit(proposed: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """Trees from a sample of four fifths of the distinct labelled candidates, an equal quota for each kind and label; thresholds from all
    others. A part that lacks a label takes all candidates. Without candidates of both labels, a model that adds nothing."""
    distinct = stored(proposed.dropDuplicates(["kind", "draw"]))
    part = F.pmod("draw", F.lit(5))
    strata = distinct.groupBy("kind", "label").agg(F.count_if(part != 0).alias("n")).collect()
    if len({r["label"] for r in strata}) < 2:
        return Model([], {})
    quota = shared_out([r["n"] for r in strata], sample)
    share = F.lit(0.0)
    for r, q in zip(strata, quota):
        share = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), q / max(r["n"], 1)).otherwise(share)
    lot = F.pmod(F.xxhash64("draw", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
    marked = stored(distinct.withColumn("_trains", (part != 0) & (lot < share)))
    counts = {(r["_trains"], r["label"]): r["count"] for r in marked.groupBy("_trains", "label").count().collect()}
    drawn, held = (marked.where(F.col("_trains") == t) if all(counts.get((t, y)) for y in (0.0, 1.0)) else marked for t in (True, False))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn)
    learned = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1).fit(assembled)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(learned.treeWeights, learned.trees)]
    margin = F.round(_scored(trees, {c: F.col(c) for c in FEATURES}) * 20)  # calibration in steps of a twentieth: a bounded table
    steps = held.groupBy("kind", margin.alias("step")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).orderBy("kind", F.col("step").desc()).collect()
    thresholds: dict[str, float] = {}
    for kind in PROPOSED:
        hits = n = 0
        for row in (r for r in steps if r["kind"] == kind):
            hits, n = hits + row["hits"], n + row["n"]
            if hits >= precision * n:
                thresholds[kind] = max((row["step"] - 0.5) / 20, -0.5)
    return Model(trees, thresholds)


def with_spans(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Adds ``_all``: base spans and the chosen candidates, by start, then kind."""
    def measured(kind: str):
        def one(s: Column) -> Column:
            f = features(s["match"], s["before"], kind)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[f[c].cast("double").alias(c) for c in FEATURES])

        return one

    def scored(kind: str):
        def one(s: Column) -> Column:
            excess = model.excess(kind, {c: s[c] for c in FEATURES})
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), excess.cast("double").alias("excess"))

        return one

    chosen = [F.transform(F.transform(f"_{name}", measured(kind)), scored(kind)) for name, (kind, _) in GENERATORS.items()]
    free = lambda s: (s["excess"] >= 0) & ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_chosen", F.array_sort(F.filter(F.concat(*chosen), free)))

    def best(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = F.coalesce(s["start"] >= last["end"], F.lit(True))
        better = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(apart, F.concat(kept, F.array(s))).when(s["excess"] > last["excess"], better).otherwise(kept)

    none = F.array().cast("array<struct<start:int,end:int,kind:int,excess:double>>")
    kept = F.when(F.size("_chosen") > 0, F.aggregate("_chosen", none, best)).otherwise(none)
    extra = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn("_all", F.array_sort(F.concat("_base", extra)))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _marked(docs: DataFrame, text: str) -> DataFrame:
    spanned = base_spans(docs, text)
    model = fit(candidates(spanned, text).unionByName(seeds(docs.sparkSession)))
    return with_spans(spanned, text, model)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end by start, then kind; code points), one row per
    input row. Null and empty texts have no spans; repeated rows give repeated results; other columns are ignored."""
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spanned = _marked(own, "_text")
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    return spanned.select(F.col("_key").alias("doc_id"), *counts, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; touching and overlapping spans become one,
    named after the first. All other columns, null texts and the row count are unchanged."""
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    its = f"_c{docs.columns.index(text)}"
    spanned = _marked(plain.withColumn("_text", F.coalesce(F.col(its), F.lit(""))), "_text")

    def joined(runs: Column, s: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(runs) == 0) | (s["start"] > last["end"])
        return F.when(apart, F.concat(runs, F.array(s))).otherwise(F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer)))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spanned = spanned.withColumn("_runs", F.when(F.size("_all") > 0, F.aggregate("_all", empty, joined)).otherwise(empty))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.lit(0)

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, zero).otherwise(F.element_at(F.col("_runs"), F.greatest(i, F.lit(1)))["end"])
        return F.concat(F.substr(F.col("_text"), begin + 1, s["start"] - begin), F.element_at(names, s["kind"] + 1))

    tail = F.substr(F.col("_text"), F.element_at("_runs", -1)["end"] + 1)
    new = F.when(F.size("_runs") > 0, F.concat(F.array_join(F.transform("_runs", piece), ""), tail)).otherwise(F.col(its))
    return spanned.withColumn("_new", new).select(*[F.col("_new") if c == its else F.col(c) for c in plain.columns]).toDF(*docs.columns)
