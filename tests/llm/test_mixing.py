"""Temperature mixing against a plain version."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tests.llm.test_text_operators import SCHEMA, WORD, corpus


def weights(sizes, mix):
    return [(s / sum(sizes)) ** mix.alpha / mix.norm if s else 0.0 for s in sizes]


def entropy(w):
    return -sum(x * math.log(x) for x in w if x)


@pytest.mark.parametrize("share", [0.99, 0.9, 0.5, 0.2])
def test_targets_above_and_below_the_natural_entropy(share):
    for sizes in ([900.0, 60.0, 40.0, 0.0], [500.0, 300.0, 200.0]):
        mix = mixing.solve(mixing.listed(sizes), share, 1e9)
        w = weights(sizes, mix)
        assert mix.entropy_met and abs(sum(w) - 1) < 1e-9
        assert abs(entropy(w) / math.log(3) - share) < 1e-5 and abs(mix.entropy - entropy(w)) < 1e-9


def test_limits_and_what_cannot_be_met():
    sizes = [900.0, 60.0, 40.0]
    free = mixing.solve(mixing.listed(sizes), 0.9, 100)
    for share, side in ((0.9, 1), (0.2, -1)):
        tight = mixing.solve(mixing.listed(sizes), share, 1.05)
        assert abs(tight.repetition - 1.05) < 1e-5 and tight.repetition_met and not tight.entropy_met
        assert abs(max(w * tight.budget / s for w, s in zip(weights(sizes, tight), sizes)) - tight.repetition) < 1e-9
        assert (tight.alpha < 1) == (side > 0) or abs(tight.alpha - 1) < 0.2
    assert free.entropy_met and free.alpha < 1
    assert not mixing.solve(mixing.listed([5.0, 5.0]), 0.3, 9).entropy_met  # equal sizes stay equal
    assert not mixing.solve(mixing.listed(sizes), 0.9, 2.0, budget=5000.0).repetition_met
    assert mixing.solve(mixing.listed([]), 1, 1).budget == 0 and mixing.solve(mixing.listed([0.0]), 1, 1).budget == 0
    cover = mixing.solve(mixing.listed(sizes), 1.0, 1.5, cover=True)
    assert min(w * cover.budget / s for w, s in zip(weights(sizes, cover), sizes)) > 1 - 1e-9 and cover.repetition <= 1.5 + 1e-9


def plain_copies(rows, mix, seed):
    """Copies by document: whole passes, then blocks in the next pass's order, then documents of the edge block, while they fit."""
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["n"]
    total, out = sum(size.values()), {}
    for source, tokens in size.items():
        mine = [r for r in rows if r["source"] == source]
        want = (tokens / total) ** mix.alpha / mix.norm * mix.budget if tokens else 0
        passes = math.floor(want / tokens + 1e-9) if tokens else 1
        rest = max(0, math.floor(want - passes * tokens + 1e-6)) if tokens else 0
        blocks = collections.defaultdict(list)
        for r in mine:
            blocks[r["orders"][passes]].append(r)
        used, taken = 0, set()
        for order in sorted(blocks):
            weight = sum(r["n"] for r in blocks[order])
            if used + weight <= rest:
                used += weight
                taken |= {r["id"] for r in blocks[order]}
                continue
            places = collections.defaultdict(list)
            for r in blocks[order]:
                places[r["within"]].append(r)
            for place in sorted(places):
                used += sum(r["n"] for r in places[place])
                if used > rest:
                    break
                taken |= {r["id"] for r in places[place]}
            break
        out |= {r["id"]: passes + (r["id"] in taken) for r in mine}
    return out


@pytest.mark.parametrize("share, limit", [(0.9, 2.7), (0.999, 50.0)])
def test_copies_are_those_of_the_plain_version(spark, monkeypatch, share, limit):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    docs = spark.createDataFrame([(i, t, a, "big" if i % 3 else s, n) for i, t, a, s, n in corpus()], SCHEMA)
    mix, plans = mixing.plan(mixing.measure(docs), share, limit)
    hashed = docs.select("doc_id", "source", "text", mixing._block(17).alias("block"), mixing._within(17).alias("within"))
    hashed = hashed.withColumn("orders", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda n: mixing._place(17, n.cast("long"))))
    rows = [{"id": r["doc_id"], "source": r["source"], "n": len(WORD.findall(r["text"] or "")), "within": r["within"], "orders": r["orders"]} for r in hashed.collect()]
    # own columns of any name are kept; those named like results are replaced
    clash = docs.withColumns({"passes": F.lit(7), "plan_source": F.lit("x"), "block_cut": F.lit(1), "doc_cut": F.lit(2), "row": F.lit("r"), "copies": F.lit("no")})
    got = mixing.assign(clash, plans).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == plain_copies(rows, mix, 17)
    assert {(r["passes"], r["plan_source"], r["block_cut"], r["doc_cut"], r["row"]) for r in got} == {(7, "x", 1, 2, "r")}
    order = {r["id"]: r["orders"] for r in rows}
    assert all(r["places"] == order[r["doc_id"]][: r["copies"]] for r in got)
    real = mixing.realise(clash, plans)
    assert real.columns == clash.columns and real.count() == sum(r["copies"] for r in got)
    mixed = mixing.realise(docs, plans, keep_order=True).where("mix_pass < 2").collect()
    runs = [[r["mix_place"] for r in mixed if r["mix_pass"] == n and r["source"] == "big"] for n in (0, 1)]
    assert not set(runs[0]) & set(runs[1])  # every pass has an order of its own


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.realise(empty, mixing.plan(mixing.measure(empty), 0.9, 2)[1]).count() == 0
