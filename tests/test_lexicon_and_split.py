"""The lexicon with learned terms, and records written once to three results."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recordweave.sources import lexicon, split, tables

DOC = {"industries": {"Robots": ["Robot arm", "gripper"], "Audio": ["Amplifier"]}, "job_titles": ["Buyer", "CTO"], "templates": ["x"]}
T = datetime(2024, 1, 1)


def library(spark, tmp_path, doc=DOC):
    (tmp_path / "lib.json").write_text(json.dumps(doc, indent=2))
    return lexicon.library(spark, f"file://{tmp_path}/lib.json")


def test_library_keeps_its_order(spark, tmp_path):
    got = sorted(map(tuple, library(spark, tmp_path).collect()), key=repr)
    assert got == sorted([("products", "Robots", 0, 0, "Robot arm"), ("products", "Robots", 0, 1, "gripper"), ("products", "Audio", 1, 0, "Amplifier"), ("job_titles", None, None, 0, "Buyer"), ("job_titles", None, None, 1, "CTO")], key=repr)
    assert library(spark, tmp_path, {}).collect() == []


def test_merging_is_ordered_and_blind_to_case(spark, tmp_path):
    rows = [("ROBOT ARM", "products", "Robots", T), ("Welder", "products", " Robots ", T + timedelta(1)), ("welder", "products", "Robots", T), ("Tube", "products", "Novel", T), ("x", "products", " ", T), (" ", "products", "Audio", T), ("cto", "job_titles", None, T), ("Smith", "job_titles", "Audio", T), ("Sourcing", "procurement_terms", None, T)]
    learned = spark.createDataFrame([(t, f, i, "https://a.example", at) for t, f, i, at in rows], lexicon.LEARNED)
    got = sorted((r.term_type, r.industry or "", r.pos, r.term) for r in lexicon.merged(library(spark, tmp_path), learned).collect())
    assert got == [("job_titles", "", 0, "Buyer"), ("job_titles", "", 1, "CTO"), ("job_titles", "", 2, "Smith"), ("procurement_terms", "", 0, "Sourcing"), ("products", "Audio", 0, "Amplifier"), ("products", "Novel", 0, "Tube"), ("products", "Robots", 0, "Robot arm"), ("products", "Robots", 1, "gripper"), ("products", "Robots", 2, "welder")]


def test_terms_of_three_families():
    assert lexicon.terms_of("Hire, Senior Hardware Engineer. senior engineer. PCB Assembly; pcb assembly") == [("products", "Senior Hardware"), ("job_titles", "Senior Hardware Engineer"), ("procurement_terms", "PCB Assembly")]
    assert lexicon.terms_of("smart water sensors. Smart Water Sensors") == [("products", "smart water sensors")]
    assert lexicon.terms_of("") == [] and lexicon.terms_of("software system") == []


def plain(texts, known):
    """A text after the other."""
    known, out = {k.lower() for k in known}, []
    for at, url, text, industry in sorted(texts, key=lambda t: (t[0], t[1])):
        added = 0
        for family, term in lexicon.terms_of(text) if url.startswith(("http://", "https://")) else ():
            if term.lower() not in known and added < lexicon.MOST:
                known.add(term.lower())
                out.append((term, family, industry))
                added += 1
    return sorted(out)


def test_learning_goes_a_text_after_the_other(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = [f"{a} {b}" for a in ("red", "blue", "fast", "tiny") for b in ("sensor", "Camera", "robot", "gateway")]
    texts = [(T + timedelta(hours=k), f"https://s{k}.example" if k % 7 else "ftp://no.example", ". ".join(rng.choice(words) for _ in range(rng.randrange(14))), f"i{k % 3}") for k in range(25)]
    frame = spark.createDataFrame([(t, i, u, at) for at, u, t, i in texts], "text string, industry string, source_url string, at timestamp").repartition(4)
    base = spark.createDataFrame([("RED SENSOR",)], "term string")
    got = lexicon.learn(frame, base)
    assert sorted((r.term, r.term_type, r.industry) for r in got.collect()) == plain(texts, ["red sensor"])
    folder = f"file://{tmp_path}/learned"
    assert lexicon.teach(frame, base, folder) == 1
    first = tables.read(spark, folder).count()
    assert first == got.count() > 8
    lexicon.teach(frame.withColumn("text", F.concat("text", F.lit(". odd new terminal"))), base, folder)
    assert tables.read(spark, folder).where("key like '%terminal'").count() == 1 and tables.read(spark, folder).count() >= first + 1


def test_one_write_gives_accepted_rejected_and_counts(spark, tmp_path):
    folder = f"file://{tmp_path}/leads"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, name string").repartition(3)
    key = F.lower(F.trim("name"))
    assert split.append(rows((1, "A"), (2, "b"), (3, " a "), (4, None), (5, None)), folder, key, ["id"]) == {"added": 3, "skipped": 2, "total": 3}
    assert sorted(r.id for r in split.accepted(spark, folder).collect()) == [1, 2, 4] and sorted(r.id for r in split.rejected(spark, folder).collect()) == [3, 5]
    assert split.append(rows((9, "B"), (8, "c")), folder, key, ["id"]) == {"added": 1, "skipped": 1, "total": 4}
    assert sorted(r.id for r in split.accepted(spark, folder).collect()) == [1, 2, 4, 8] and [r.id for r in split.rejected(spark, folder).collect()] == [9]
    assert split.append(rows(), folder, key, ["id"]) == {"added": 0, "skipped": 0, "total": 4}
    assert sorted((r.version, r.added, r.skipped, r.total) for r in split.metrics(spark, folder).collect()) == [(1, 3, 2, 3), (2, 1, 1, 4), (3, 0, 0, 4)]
