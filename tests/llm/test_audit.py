import math
import random
import re
from collections import Counter
from itertools import permutations

from quizloom.llm import audit

ORDERS = ["".join(p) for p in permutations("ABCDE")]


def test_paths_count_orders():
    reaching, leaving = audit.paths(5)
    for state in range(32):
        size = state.bit_count()
        assert reaching[state] == math.factorial(size) and leaving[state] == math.factorial(5 - size)
    found = audit.edges("ABCDE")
    assert len(found) == 80 and all(e["orders"] == len(e["uses"]) for e in found)
    assert Counter(o for e in found for o, _ in e["uses"]) == {o: 5 for o in ORDERS}


def failed(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = set()
        if len(words) < 50:
            own.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            own.add("C")
        if re.search(r"[#$%&*|]", text):
            own.add("D")
        if doc_id is not None and first[text] < doc_id:
            own.add("E")
        out.append((doc_id, part or "", own))
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, docs = {}, failed(rows)
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        total = Counter()
        for order in ORDERS:
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                earlier = sum(name in f and bool(f & set(order[:step - 1])) for _, f in own)
                alone = sum(f == {name} for _, f in own)
                out[part, order, step] = [
                    len(left), len(gone), earlier, alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                total[name] += len(gone)
        for order in ORDERS:
            for step, name in enumerate(order, 1):
                out[part, order, step].append(total[name])
    return out


def made():
    rng = random.Random(7)
    words = ["a", "b", "cc", "Dd", "EE", "f#", "g|", "h", "i", "j"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(260):
        kind = rng.randrange(4)
        text = " ".join(rng.choices(words[:rng.choice([6, 90])], k=rng.choice([3, 49, 50, 90])))
        text = [text, text, "same text of many", text.lower().replace("#", "")][kind]
        rows.append((i, text, rng.choice(["hot", "hot", "web", None, ""])))
    rows += [(300, None, "web"), (301, "", "hot"), (302, "\t\n ", "x"), (None, "same text of many", "hot"), (None, None, "hot"),
             (5, "same text of many", "hot"), (5, "same text of many", "hot"), (-1, "x" * 100_000, None),
             (303, "Word " * 70_000, "one.part"), (304, "Word " * 70_000, "one.part")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (300, 1, 0), (9999, 1, 1)]
    return rows, labels


def test_matches_every_order_run(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, `e.state` int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(docs.repartition(5), marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                             "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in found.collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), marks).count() == 0
    got = audit.audit(docs, marks.limit(0)).collect()
    assert len(got) == 600 and {(r.good_lost, r.toxic_lost) for r in got} == {(0, 0)}


def test_texts_stay_where_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Cartesian" not in plan
