"""Personal data by candidate gradient boosting, in built-in functions only.

1. Base spans: four fixed patterns with their checks (always reported).
2. High-recall generators propose further, overlapping spans (spelled-out mail
   addresses, cards glued to other numbers, telephone numbers without a plus
   sign in the usual groupings, IPv6 addresses, also compressed) with format and context features.
3. Labels come from two sides. Weak ones from all rows: a candidate that overlaps a base
   span of its kind is personal data; one that fails its kind's check, or is glued to
   letters, is not; of the rest, mail addresses, IP addresses and phone numbers
   without a cue nearby are not either (no check digit vouches for them). Base
   spans stand a second time as if written in a form that only the generators
   propose. Known ones from a seeded set of planted texts (``planted``): every kind in
   forms that the base patterns cannot see, with and without a cue, among look-alikes.
   All are aggregated to distinct feature rows (at most the product of the features'
   values) and boosted trees are fitted to their weighted counts.
4. On held-out documents and planted texts each kind gets the lowest threshold that
   keeps the wanted precision among the candidates that can be added, that is, that
   touch no base span. The planted ones stand for a prior: on a small table they
   decide, with a table's own candidates growing they are outweighed, and nothing
   switches at any size. The trees compile to one SQL expression, and candidates
   above their kind's threshold that overlap no base span are added.

Both passes over the texts are row-local; only feature counts are shuffled.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, free_names, id_text, let, written

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, written so that no start or end is tried twice: a look-behind
# (or the end of the last match) stands for "the first start from which it can
# match", and possessive loops where nothing that follows could take less.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without these cannot hold the kind
GATE = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
CANDIDATES = {
    # a domain name has at most 127 labels
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|[\[(]at[\])]|\x20at\x20)\x20?[a-z0-9-]++"
             r"(?:\x20?(?:\.|[\[(]dot[\])]|\x20dot\x20)\x20?[a-z0-9-]++){1,126}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:(?:[0-9A-Fa-f]{1,4}:){1,7}|:):[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|"
          r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})|[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-][0-9]{4}){3}|[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])\+?(?:(?:[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}|"
             r"0[1-9](?:[\x20./-][0-9]{2}){4}|\(?0[0-9]{2,4}\)?[\x20./-][0-9]{5,8})(?![0-9])",
}
#: a text without these has no candidate of the kind; each is a part of every match, or wider
CANDIDATE_GATE = {"email": r"@|(?i)[(\[]at[)\]]|(?i)\x20at\x20\x20?[a-z0-9-]++\x20?(?:\.|[\[(]dot[\])]|\x20dot\x20)", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]|::[0-9A-Fa-f]|[0-9A-Fa-f]::", "card": "[0-9]{4}", "phone": "[0-9]\\)?[\x20./-][0-9]{2}"}
CUES = {"email": "mail|contact|write|@", "ip": r"\bip\b|host|address|server|login", "card": "card|visa|master|credit|payment|pay", "phone": "tel|phone|call|mobile|fax|contact|whatsapp"}
#: characters of context a feature may look at on either side
CONTEXT = 32
#: the features and how many values each can take (their product bounds the table that trees are fitted to)
FEATURES = {"kind_no": 4, "valid": 2, "glued": 2, "quoted": 2, "cue": 2, "separators": 4, "digits": 5, "varied": 2, "form": 3, "overlaps": 2}
#: texts of each kind in the planted set, and the share of all training weight that they have at least
PLANTED, PLANTED_SHARE = 600, 0.1
#: eight groups, or fewer around one '::'
IPV6 = r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)(?!(?:[0-9A-Fa-f]*:){9})[0-9A-Fa-f:]+)$"
SPAN = "array<struct<kind_no:int,start:bigint,end:bigint>>"


def _luhn(digits: Column) -> Column:
    place = lambda c, i: F.when(i % 2 == 1, F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int") + 1)).otherwise(c.cast("int"))
    parts = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0), place)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _form(kind: str, m: Column) -> Column:
    """How a candidate is written: mail with a sign, brackets or words; IP of either version, compressed; cards
    in one piece, by blanks or otherwise; phones with a plus sign, a trunk zero or neither."""
    if kind == "email":
        return F.when(m.contains("@"), 0).when(m.rlike(r"(?i)[\[(]at[\])]"), 1).otherwise(2)
    if kind == "ip":
        return F.when(~m.contains(":"), 0).when(m.contains("::"), 2).otherwise(1)
    if kind == "card":
        return F.when(~m.rlike("[^0-9]"), 0).when(~m.rlike(r"[^0-9\x20-]"), 1).otherwise(2)
    return F.when(m.startswith("+"), 0).when(m.rlike(r"^\(?0"), 1).otherwise(2)


def _matches(text: Column, pattern: str, gate: str, row) -> Column:
    """``row(match, start, end, left, right)`` of every match, in order; positions are
    code points. The text between two matches is the context on their sides."""
    def walk(b: Column) -> Column:
        m, p = b["m"], b["p"]
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        step = lambda a, i: F.struct(
            (a["at"] + F.length(F.get(p, i)) + F.length(F.get(m, i))).alias("at"),
            F.concat(a["starts"], F.array(a["at"] + F.length(F.get(p, i)))).alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda a: a["starts"])
        return let(starts, lambda s: F.transform(m, lambda x, i: row(
            x, F.get(s, i), F.get(s, i) + F.length(x), F.right(F.get(p, i), F.lit(CONTEXT)), F.left(F.get(p, i + 1), F.lit(CONTEXT)))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), 0),
                 lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), walk)))
    return F.when(text.rlike(gate), found)


def base_spans(text: Column) -> Column:
    """Spans that the four fixed patterns and their checks give, by kind, then start."""
    out = []
    for k, kind in enumerate(KINDS):
        row = lambda m, s, e, left, right, k=k, kind=kind: F.struct(F.lit(k).alias("kind_no"), s.alias("start"), e.alias("end"), _valid(kind, m).alias("ok"))
        got = F.filter(_matches(text, BASE[kind], GATE[kind], row), lambda x: x["ok"])
        out.append(F.coalesce(F.transform(got, lambda x: F.struct(x["kind_no"], x["start"], x["end"])), F.array().cast(SPAN)))
    return F.concat(*out)


def _overlap(x: Column, spans: Column, same_kind: bool) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]) & (b["kind_no"] == x["kind_no"] if same_kind else F.lit(True)))


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans of all kinds with their features and weak label (null: unlabelled)."""
    out = []
    for k, kind in enumerate(KINDS):
        def row(m, s, e, left, right, k=k, kind=kind):
            digits = F.regexp_replace(m, "[^0-9]", "")
            seps = F.length(F.regexp_replace(m, r"[0-9A-Za-z]", ""))
            n = F.length(digits)
            near, after = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
            spoken = F.regexp_replace(F.regexp_replace(m, r"(?i)\x20?(?:[\[(]at[\])]|\x20at\x20)\x20?", "@"), r"(?i)\x20?(?:[\[(]dot[\])]|\x20dot\x20)\x20?", ".")
            valid = spoken.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") if kind == "email" \
                else (_valid(kind, m) | m.rlike(IPV6)) if kind == "ip" else _valid(kind, m)
            return F.struct(
                F.lit(k).alias("kind_no"), s.alias("start"), e.alias("end"), F.coalesce(valid, F.lit(False)).cast("int").alias("valid"),
                (near.rlike(r"[\p{L}\p{N}_#$]$") | after.rlike(r"^[\p{L}\p{N}_#$]")).cast("int").alias("glued"),
                (near.rlike(r"[\"'=/]\x20?$") | after.rlike(r"^[\"'=/]")).cast("int").alias("quoted"),
                F.lower(near).rlike(CUES[kind]).cast("int").alias("cue"), F.least(seps, F.lit(3)).alias("separators"),
                (F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).otherwise(4)).alias("digits"),
                (F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9]"), 0))) > 3).cast("int").alias("varied"), _form(kind, m).alias("form"))
        out.append(F.coalesce(_matches(text, CANDIDATES[kind], CANDIDATE_GATE[kind], row), F.array()))
    both = let(F.concat(*out), lambda c: F.transform(c, lambda x: F.struct(
        x.getField("kind_no").alias("kind_no"), x["start"].alias("start"), x["end"].alias("end"),
        *[x[f].alias(f) for f in FEATURES if f not in ("kind_no", "overlaps")],
        (_overlap(x, base, False) & ~_overlap(x, base, True)).cast("int").alias("overlaps"),
        F.when(_overlap(x, base, True), 1).when((x["valid"] == 0) | (x["glued"] == 1), 0).alias("label"))))
    return both


def find(docs: DataFrame, text_col: str = "text", base_col: str = "base", cand_col: str = "candidates") -> DataFrame:
    """``docs`` with base spans and candidates appended (names must be free)."""
    return (docs.withColumn(base_col, base_spans(F.col(text_col)))
            .withColumn(cand_col, let(F.col(base_col), lambda b: candidates(F.col(text_col), b))))


@dataclass
class Model:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, and a threshold per kind (None: add nothing)."""

    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    measured: dict[int, tuple[int, int]] = field(default_factory=dict)  # held-out rows over the threshold: right ones, all
    planted: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # held-out planted spans: right ones added, all added, all there are

    def score(self, x: Column | None = None) -> Column:
        """Probability as one expression over a struct's fields (or plain columns)."""
        names = list(FEATURES)

        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            f, cut, low, high = t
            value = F.col(names[f]) if x is None else x[names[f]]
            return F.when(value <= cut, walk(low)).otherwise(walk(high))

        margin = F.lit(0.0)
        for w, t in self.trees:
            margin = margin + F.lit(float(w)) * walk(t)
        return 1 / (1 + F.exp(-2 * margin))

    def additions(self, cands: Column, base: Column) -> Column:
        """Candidates over their kind's threshold that touch no base span. In order of their starts,
        one that touches the one kept before it replaces it where its score is greater, or
        equal and it is longer."""
        if not self.thresholds:
            return F.array().cast(SPAN)
        cut = lambda x: F.element_at(F.lit([self.thresholds.get(k, 2.0) for k in range(len(KINDS))]), x["kind_no"] + 1)
        chosen = F.filter(cands, lambda x: (self.score(x) >= cut(x)) & ~_overlap(x, base, False))
        ordered = F.sort_array(F.transform(chosen, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind_no"].alias("kind_no"), F.round(self.score(x), 6).alias("score"))))
        kept = "array<struct<start:bigint,end:bigint,kind_no:int,score:double>>"

        def step(a, x):
            last = F.get(a, F.size(a) - 1)
            apart = F.coalesce(x["start"] >= last["end"], F.lit(True))
            better = (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (x["end"] - x["start"] > last["end"] - last["start"]))
            return F.when(apart, F.concat(a, F.array(x))).when(better, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a)

        best = F.aggregate(ordered, F.array().cast(kept), step)
        return F.transform(best, lambda x: F.struct(x["kind_no"].alias("kind_no"), x["start"].alias("start"), x["end"].alias("end")))


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    s = node.split()
    return s.featureIndex(), s.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def labelled(found: DataFrame, folds: int, cand_col: str) -> DataFrame:
    """(held, addable, the features, label, count): candidates by their weak labels,
    and valid base spans once more in a form that can be added."""
    x = F.col("x")
    bare = (x["kind_no"] != KINDS.index("card")) & (x["cue"] == 0) & (x["overlaps"] == 0)
    label = F.coalesce(x["label"], F.when(bare, F.lit(0)))
    # '@' and '.' spelled out are three separators and more, a phone number loses its plus sign
    form = F.when(x["kind_no"] == KINDS.index("email"), 3).when(x["kind_no"] == KINDS.index("phone"), F.greatest(x["separators"] - 1, F.lit(2))).otherwise(x["separators"])
    # a mail address is rewritten with brackets
    style = F.when(x["kind_no"] == KINDS.index("email"), 1).when((x["kind_no"] == KINDS.index("phone")) & (x["form"] == 0), 2).otherwise(x["form"])
    other = {"separators": form, "form": style}
    row = lambda addable, changed, y: F.struct(addable.alias("addable"), *[changed.get(f, x[f]).cast("int").alias(f) for f in FEATURES], y.cast("int").alias("label"))
    own = F.when(label.isNotNull(), row((label == 0) & (x["overlaps"] == 0), {}, label))
    # a card or an IPv4 address has no such other form
    again = F.when((x["label"] == 1) & (x["valid"] == 1) & (x["glued"] == 0) & x["kind_no"].isin(KINDS.index("email"), KINDS.index("phone")), row(F.lit(True), other, F.lit(1)))
    each = found.select((crc_fold(F.col("doc_id"), folds) == 0).alias("held"), F.explode(cand_col).alias("x"))
    return each.select("held", F.inline(F.array_compact(F.array(own, again)))).groupBy("held", "addable", *FEATURES, "label").count()


def planted(n: int = PLANTED, seed: int = 11) -> list[tuple[int, str, int, int, int]]:
    """(id, text, kind number, start, end) of a seeded set of texts: per kind ``n`` texts, half with personal
    data in a form that the base patterns cannot see, half with a look-alike (start = end = -1)."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k, first="0123456789": pick(first) + "".join(pick("0123456789") for _ in range(k - 1))
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    group = lambda: f"{rng.randrange(1, 1 << 16):x}"

    def number(n: int, ok: bool, first: str = "0123456789") -> str:
        """``n`` digits that pass Luhn's check or do not."""
        body = digits(n - 1, first)
        good = (10 - sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(body[::-1], 1))) % 10) % 10
        return body + str(good if ok else (good + rng.randint(1, 9)) % 10)

    def card(ok: bool) -> str:
        return number(16, ok, "45")

    def cut(number: str, sep: str) -> str:
        return sep.join(number[i:i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", " . "), (" (at) ", " (dot) ")])
        return word() + at + dot.join([word() for _ in range(pick([1, 1, 1, 2, 3, 5]))] + [pick(["com", "org", "net", "de", "fr"])])

    def ip() -> str:
        full = [group() for _ in range(8)]
        keep = rng.randint(1, 4)
        return pick([":".join(full), ":".join(full[:keep]) + "::" + ":".join(full[8 - rng.randint(1, 6 - keep):]), "fe80::" + ":".join(full[4:])])

    def phone() -> str:
        return pick([f"({digits(3, '23456789')}) {digits(3)}-{digits(4)}", f"{digits(3, '23456789')}-{digits(3)}-{digits(4)}", f"0{digits(3, '123456789')} {digits(7)}",
                     "0" + digits(1, "12345679") + "".join(f" {digits(2)}" for _ in range(4)), f"0{digits(2, '23456789')}/{digits(8)}"])

    cue = {"email": ["mail me: ", "contact ", "please write to ", "e-mail "], "ip": ["server ", "host is ", "ip address ", "login from "],
           "card": ["card ", "visa ", "payment by ", "credit card no "], "phone": ["call ", "phone ", "tel. ", "mobile "]}
    found = {"email": email, "ip": ip, "card": lambda: pick([cut(card(True), pick(["/", "."])), card(True) + " " + card(True)]), "phone": phone}
    like = {
        "email": lambda: pick([f"look at the dot {word()} age", f"stay at home.{word()}", f"it ends at {word()} dot {word()}", f"met {word()} at {word()}.{word()}"]),
        "ip": lambda: pick([f"{rng.randint(0, 23)}:{digits(2)}:{digits(2)}:{digits(2)}", f"a::{word()[:1]}", f"{digits(3, '3456789')}.{digits(3)}.{digits(2)}.{digits(3)}", f"std::{word()}"]),
        "card": lambda: pick([cut(card(False), pick(["/", "."])), card(False) + " " + card(False), number(17, False) + " " + number(18, False)]),
        "phone": lambda: pick([f"{digits(3, '23456789')}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(2)}/{digits(3)}-{digits(4)}", f"0{digits(3)}-{digits(6)}"])}
    calm = ["order ", "see ", "then ", "number ", "the part ", "so "]
    out = []
    for k, kind in enumerate(KINDS):
        for i in range(n):
            real = i % 2 == 0
            what = found[kind]() if real else like[kind]()
            # mail in brackets and cards speak for themselves; the other forms need a cue
            plain = real and (kind == "card" or kind == "ip" or kind == "email" and ("[" in what or "(" in what)) and i % 4 == 0
            lead = pick([word() + " ", "", f"{word()} {word()} "]) + (pick(calm) if plain or not real else pick(cue[kind]))
            text = lead + what + pick(["", " " + word(), ", " + word(), "."])
            out.append((len(out), text, k, len(lead) if real else -1, len(lead) + len(what) if real else -1))
    return out


def planted_rows(spark, folds: int) -> DataFrame:
    """The planted candidates that touch no base span as ``labelled`` rows, and how many planted spans of a kind and fold there are
    (label 2, one row each kind and fold)."""
    schema = "doc_id long, text string, kind_no int, start long, end long"
    texts = find(spark.createDataFrame(planted(), schema).coalesce(1))
    held = (crc_fold(F.col("doc_id"), folds) == 0).alias("held")
    each = texts.select(held, "kind_no", "start", "end", F.explode("candidates").alias("x")).where(F.col("x.overlaps") == 0).where(F.col("x.label").isNull() | (F.col("x.label") == 0))
    right = (F.col("x.kind_no") == F.col("kind_no")) & (F.col("x.start") < F.col("end")) & (F.col("start") < F.col("x.end"))
    rows = each.select("held", F.lit(True).alias("addable"), *[F.col(f"x.{f}").cast("int").alias(f) for f in FEATURES], right.cast("int").alias("label"))
    total = texts.where("start >= 0").select(held, F.lit(True).alias("addable"), *[(F.col("kind_no") if f == "kind_no" else F.lit(0)).alias(f) for f in FEATURES], F.lit(2).alias("label"))
    return rows.unionAll(total).groupBy("held", "addable", *FEATURES, "label").count()


def fit(found: DataFrame, precision: float = 0.97, rounds: int = 8, depth: int = 4, folds: int = 5,
        base_col: str = "base", cand_col: str = "candidates") -> Model:
    """Fit on all candidates of ``found`` (doc_id, candidates) and the planted set: documents
    and texts of fold 0 calibrate, the others train.

    Only the counts of distinct feature rows leave the executors; their number
    is bounded by the product of FEATURES, whatever the input's size.
    """
    own = labelled(found, folds, cand_col).withColumn("own", F.lit(True))
    both = own.unionAll(planted_rows(found.sparkSession, folds).withColumn("own", F.lit(False)))
    table = written(both.coalesce(1), "pii-features")
    train = {r["own"]: r["n"] for r in table.where("not held and label < 2").groupBy("own").agg(F.sum("count").alias("n")).collect()}
    boost = max(1.0, PLANTED_SHARE / (1 - PLANTED_SHARE) * train.get(True, 0) / train[False])
    weighted = table.where("not held and label < 2").withColumn("weight", F.col("count") * F.when(F.col("own"), 1.0).otherwise(boost)).withColumn("y", F.col("label").cast("double"))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(weighted)
    model = GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=8).fit(data)
    out = Model([(w, _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)])
    scored = table.where("held and addable").select("own", "kind_no", "label", "count", F.when(F.col("label") < 2, F.round(out.score(), 4)).alias("p")).groupBy("own", "kind_no", "p").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("label") == 1).cast("int")).alias("good")).collect()
    for k in range(len(KINDS)):
        rows = [r for r in scored if r["kind_no"] == k and r["p"] is not None]
        good = n = 0
        for p in sorted({r["p"] for r in rows if r["p"] > 0.5}, reverse=True):
            good, n = (x + sum(r[c] for r in rows if r["p"] == p) for x, c in ((good, "good"), (n, "n")))
            # precision with one more wrong one than seen
            if good / (n + 1) >= precision:
                out.thresholds[k], out.measured[k] = p - 5e-5, (good, n)
        cut = out.thresholds.get(k, 2.0)
        added = [r for r in rows if not r["own"] and r["p"] >= cut]
        out.planted[k] = (sum(r["good"] for r in added), sum(r["n"] for r in added), sum(r["n"] for r in scored if r["kind_no"] == k and r["p"] is None))
    return out


def _joined(spans: Column) -> Column:
    by_kind = F.sort_array(F.transform(spans, lambda x: F.struct(x["kind_no"], x["start"], x["end"])))
    name = lambda x: F.element_at(F.lit(KINDS), x["kind_no"] + 1)
    return F.array_join(F.transform(by_kind, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def contract(docs: DataFrame, precision: float = 0.97) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row.

    Counts and digest are of the base spans; ``spans`` holds these and the added
    ones. Null or empty text: no spans. Repeated rows stay repeated.
    """
    found = written(find(id_text(docs)).select("doc_id", "base", "candidates"), "pii-found")
    model = fit(found, precision)
    added = found.withColumn("added", model.additions(F.col("candidates"), F.col("base")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind_no"] == k)).cast("long")
    return added.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, precision: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by [KIND] (overlapping spans as
    one, named after the first). Null texts stay null; all other columns are kept."""
    inner = find(id_text(docs, id_col, text_col)).select("doc_id", "base", "candidates")
    model = fit(written(inner, "pii-found"), precision)
    text = F.col(text_col)
    base, cand, span = free_names(docs, "base", "candidates", "spans")
    found = find(docs, text_col, base, cand)
    spans = let(F.struct(F.col(base).alias("b"), F.col(cand).alias("c")), lambda s: F.concat(s["b"], model.additions(s["c"], s["b"])))
    found = found.withColumn(span, F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind_no"]))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    label = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.lit(KINDS), x["kind_no"] + 1)), F.lit("]"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), label(x)).alias("out"),
        x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at")))
    done = F.aggregate(span, zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.size(span) > 0, done).otherwise(text)).drop(base, cand, span)
