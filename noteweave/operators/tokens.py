"""BIO labels: aligning spans with tokens, and decoding tokens to spans, as folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types in the order of their labels.
TYPES = ["TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"]
LABELS = ["O", *(f"B-{t}" for t in TYPES), *(f"I-{t}" for t in TYPES)]
IGNORED = -100
ENTITY = "struct<start:int,end:int,type:string,confidence:double,tokens:int>"


def label_name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), number), F.lit("O"))


def align(offsets: Column, entities: Column) -> Column:
    """Label number of each token: B where it starts at or before its entity, I inside it;
    special tokens (0, 0) are ignored; of several entities the first by start counts."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"], e["end"], e["type"])))
    labels = F.array(*map(F.lit, LABELS))

    def of(t: Column) -> Column:
        e = F.get(F.filter(ordered, lambda x: (t["start"] < x["end"]) & (t["end"] > x["start"])), F.lit(0))
        name = F.concat(F.when(t["start"] <= e["start"], "B-").otherwise("I-"), e["type"])
        number = F.array_position(labels, name) - 1
        known = F.when(e.isNull() | (number < 0), 0).otherwise(number)
        return F.when((t["start"] == 0) & (t["end"] == 0), IGNORED).otherwise(known).cast("int")

    return F.transform(offsets, of)


def softmax_at(logits: Column, number: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.exp(F.get(logits, number) - top) / total


def decode(predictions: Column, offsets: Column, confidences: Column | None = None, threshold: float = 0.0, pairwise: bool = False) -> Column:
    """Spans of BIO label numbers.

    B opens a span, I of its type extends it, I of another type opens one, a stray I is
    skipped, O closes.  Confidence is the running mean, or with pairwise the mean of the old
    value and the token's.  Tokens under the threshold are skipped and close nothing; with
    pairwise the threshold is for whole spans.
    """
    conf = F.transform(predictions, lambda _: F.lit(1.0)) if confidences is None else confidences
    rows = F.arrays_zip(F.slice(predictions, 1, F.size(offsets)).alias("p"), offsets.alias("o"), conf.alias("c"))
    none = F.lit(None).cast(ENTITY)
    zero = F.struct(F.array().cast(f"array<{ENTITY}>").alias("out"), none.alias("cur"))

    def step(s: Column, t: Column) -> Column:
        name, cur, o, c = label_name(t["p"]), s["cur"], t["o"], F.coalesce(t["c"], F.lit(1.0))
        head, kind = F.substring(name, 1, 2), F.substring(name, F.lit(3), F.char_length(name))
        skip = t["p"].isNull() | ((o["start"] == 0) & (o["end"] == 0))
        if not pairwise:
            skip = skip | (c < threshold)
        new = F.struct(o["start"].alias("start"), o["end"].alias("end"), kind.alias("type"), c.alias("confidence"), F.lit(1).alias("tokens")).cast(ENTITY)
        n = cur["tokens"] + 1
        mean = (cur["confidence"] + c) / 2 if pairwise else (cur["confidence"] * (n - 1) + c) / n
        longer = F.struct(cur["start"].alias("start"), o["end"].alias("end"), cur["type"].alias("type"), mean.alias("confidence"), n.alias("tokens")).cast(ENTITY)
        done = F.when(cur.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(cur)))
        extends = (head == "I-") & cur.isNotNull() & (cur["type"] == kind)
        opens = (head == "B-") | ((head == "I-") & cur.isNotNull() & ~extends)
        closes = name == "O"
        keep = F.struct(s["out"].alias("out"), cur.alias("cur"))
        return (
            F.when(skip, keep)
            .when(opens, F.struct(done.alias("out"), new.alias("cur")))
            .when(extends, F.struct(s["out"].alias("out"), longer.alias("cur")))
            .when(closes, F.struct(done.alias("out"), none.alias("cur")))
            .otherwise(keep)
        )

    finish = lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
    out = F.aggregate(rows, zero, step, finish)
    return F.filter(out, lambda e: e["confidence"] >= threshold) if pairwise else out
