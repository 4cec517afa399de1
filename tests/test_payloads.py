"""Open payloads of any depth, what fingerprints take from them, and text scores by bounds."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from dwellgraph.functions import nested


def walked(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in walked(v, f"{path}.{k.lower()}")]
    if isinstance(value, list):
        return [x for v in value for x in walked(v, path)]
    return [(path, value)] if isinstance(value, str) else []


def made(rng, depth):
    kind = rng.choice(["text", "dict", "list", "number"] if depth else ["text"])
    if kind == "dict":
        return {rng.choice(["Phone", "note", "Контакт", "a.b", "x"]) + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))}
    if kind == "list":
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(["067 123 45 67", "0671234567", "a@b.com", "", "ім'я"]) if kind == "text" else rng.choice([1, 2.5, None, True])


def test_walk_equals_recursion(spark):
    rng = random.Random(4)
    rows = [(i, json.dumps({"root": made(rng, 7), "b": made(rng, 3)}, ensure_ascii=False)) for i in range(60)] + [(100, None), (101, "no json"), (102, "[]"), (103, '"alone"'), (104, '{"v":{"v":{"v":{"v":{"v":{"v":{"v":{"v":{"v":["deep"]}}}}}}}}}')]
    frame = spark.createDataFrame(rows, "id int, attributes string")
    got = sorted((r.id, r.path, r.value) for r in nested.strings(frame, "id", "attributes").collect())
    want = sorted((i, *x) for i, t in rows if t and t != "no json" for x in walked(json.loads(t)))
    assert got == want and any(p.count(".") > 8 for _, p, _ in got)
    assert nested.strings(frame.limit(0), "id", "attributes").count() == 0


def test_contacts_houses_and_images(spark):
    good = "AB" * 32
    rows = [(1, json.dumps({"agent": {"my_phones": ["067 0000000 0671234567", {"x": "098-1"}]}, "note": "0509999999"})), (2, json.dumps({"building_number": "", "house_number": " 12 Б "})), (3, json.dumps({"trusted_image_hashes": [{"sha256": good, "dhash": "0" * 16}, {"sha256": "zz"}, {"dhash": 5}], "demo_duplicate_group": "g"})), (4, json.dumps({"trusted_image_hashes": "none"})), (5, None)]
    frame = spark.createDataFrame(rows, "id int, attributes string")
    assert {r.id: r.tokens for r in nested.contacts(frame, "id", "attributes").collect()} == {1: ["phone:380671234567"]}
    exact, visual = nested.image_hashes(F.col("attributes"))
    got = {r.id: r for r in frame.select("id", nested.house_number(F.col("attributes")).alias("house"), exact.alias("exact"), visual.alias("visual")).collect()}
    assert [got[i].house for i in (1, 2, 3, 4, 5)] == ["", "12б", "", "", ""]
    of = lambda what, n: [hashlib.sha256(f"g:{what}:{i}".encode()).hexdigest()[:n] for i in range(2)]
    assert got[3].exact == [good.lower(), *of("image", 64)] and got[3].visual == ["0" * 16, *of("visual", 16)] and got[4].exact == got[5].exact == []


def test_texts_are_compared_where_they_can_matter(spark):
    """The same decisions as with every text compared, though most pairs are settled by their bounds."""
    from test_incremental import LISTING, listing

    from dwellgraph.operators import duplicates, fingerprints

    rng = random.Random(5)
    rows = []
    for i in range(60):
        row = list(listing(rng, i))
        row[20] = " ".join(rng.choice(["світла", "простора", "квартира", "ремонт", "меблі", "балкон"]) for _ in range(rng.randrange(0, 30)))
        rows.append(tuple(row))
    frame = spark.createDataFrame(rows, LISTING)
    prints = fingerprints.fingerprints(frame)
    pairs = duplicates.block_pairs(prints)
    every = {(r.left_id, r.right_id): r for r in duplicates.score(pairs, frame, prints).collect()}
    needed = {(r.left_id, r.right_id): r for r in duplicates.score(pairs, frame, prints, text="needed").collect()}
    assert every.keys() == needed.keys() and all(every[k].decision == needed[k].decision for k in every)
    assert all(needed[k].final >= every[k].final and needed[k].final < 78 if needed[k].bounded else (needed[k].final == every[k].final and (needed[k].conflict or needed[k].text == every[k].text)) for k in every)
    compared = sum(r.text is not None for r in needed.values())
    assert 0 < compared < 0.6 * sum(r.text is not None for r in every.values()) and {r.decision for r in every.values()} > {"rejected"}
