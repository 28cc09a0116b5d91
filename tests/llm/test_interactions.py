"""The filter audit against plain counting in every order, with smaller ids that arrive in later batches."""

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from prioscope.llm import interactions


def failed(rows):
    """Per row its part, failed filters and labels; rows are (doc_id, text, source), labels a dict of pairs."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    for i, t, part in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        yield part or "", out + "E" * (i is not None and i > low[text]), i


def brute(rows, good=(), bad=()):
    judged = list(failed(rows))
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(f, i) for p, f, i in judged if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                gone = [(f, i) for f, i in own if name in f and not before & set(f)]
                shapley[name] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not (before | {name}) & set(f) for f, _ in own), len(gone),
                    sum(name in f and bool(before & set(f)) for f, _ in own), sum(f == name for f, _ in own),
                    sum(i in good for _, i in gone), sum(i in bad for _, i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, path, labels=None):
    counts = interactions.mask_counts(spark, path, labels)
    assert counts.where("n < 0").count() == 0
    return {tuple(r)[:3]: list(tuple(r)[3:]) for r in interactions.interactions(counts).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_smaller_ids_that_arrive_later(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " $", "HELLO " * 300, long.replace("w1", "W1"), None, "", "é" * 60 + "A", "one two"]
    rows = [(100 - i, texts[i % 8] if i % 3 else long, ["a", "b", None, ""][i % 4]) for i in range(96)]
    rows += [(5, long, "a"), (5, long, "b"), (None, long, "a"), (None, "HELLO", None), (2**40, long, "c")]
    for at in range(0, len(rows), 12):
        spark.createDataFrame(rows[at:at + 12], "doc_id bigint, text string, source string").withColumn(
            "mask", F.lit("clash")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else 1) for i in range(4, 90)] + [(90, 0, 1), (90, 1, 0), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    good = {i for i in range(4, 90) if i % 2} | {90}
    assert audited(spark, f"{tmp_path}/docs", labels) == brute(rows, good, {i for i in range(4, 91) if i % 3 == 0})


def test_retraction_in_the_state():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    import pandas as pd
    state = State()

    def change(id_, part):
        frame = pd.DataFrame({"digest": [b"d"], "id": [id_], "plain": [False], "entries": [f'[["{part}", 2, false, true, 1]]']})
        return sorted(map(tuple, pd.concat(interactions._corrected((0,), iter([frame]), state)).to_numpy().tolist()))

    assert change(9, "x") == [("x", 2, False, True, 1), ("x", 18, False, True, -1)]
    assert change(11, "y") == []
    assert change(3, "z") == [("x", 2, False, True, -1), ("x", 18, False, True, 1), ("z", 2, False, True, 1), ("z", 18, False, True, -1)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/docs")
    assert audited(spark, f"{tmp_path}/docs") == {}
