import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hueframe.llm import language_id, licenses, mixing, quality_knn, quality_rules, queries

from .helpers import DOCS, awkward, empty, prose


def oracle(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


# ---- language identification


def test_languages_held_out(spark, sf):
    docs = {r["doc_id"]: r for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op1_language_id(spark, sf).collect()
    import zlib

    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and len(docs[r["doc_id"]]["text"].split()) >= 20]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.97


def test_language_edges(spark):
    df = awkward(spark)
    known = language_id.learn_dictionaries(df)
    assert set(known) <= {"en", "de", "fr"} and "en" in known
    rows = {r["doc_id"]: r for r in language_id.identify_languages(df, known).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (40, 41, 42, 44))
    assert rows[43]["lang_pred"] in known
    assert language_id.identify_languages(df, known).count() == df.count()
    assert language_id.learn_dictionaries(empty(spark)) == {}
    assert {r["lang_pred"] for r in language_id.identify_languages(df, {}).collect()} == {"und"}
    assert language_id.identify_languages(empty(spark), known).count() == 0


def test_any_number_of_languages_and_every_place_of_a_text(spark):
    """250 languages are all learnt, and what stands at a long text's end can be in a dictionary."""
    rng = random.Random(7)
    word = lambda k: "".join(chr(97 + (k * 7 + rng.randrange(9)) % 26) for _ in range(6))
    rows = [(10 * k + i, " ".join(word(k) for _ in range(60)), f"l{k:03d}") for k in range(250) for i in range(2)]
    rows += [(9000, "alpha beta " * 3000 + "omega " * 3000, "long")]
    known = language_id.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(known) == {r[2] for r in rows} and b"omega" in known["long"] and b"alpha" in known["long"]


def test_a_rare_language_leaves_the_others_alone(spark, sf):
    """One short document of a new language changes no dictionary of another, and texts in it are still found."""
    docs = queries.table(spark, sf, "documents").select("doc_id", "text", "lang")
    rare = "zzyx qwv qwv zzyx kjh vbn " * 3
    more = docs.union(spark.createDataFrame([(10**9, rare, "rare")], "doc_id long, text string, lang string"))
    alone, beside = language_id.learn_dictionaries(docs), language_id.learn_dictionaries(more)
    assert beside.pop("rare").decode().split() == rare.split() and beside == alone
    assert len({len(v) // 256 for v in alone.values() if len(v) > 16_000}) <= 2 and all(len(v) <= 16_384 for v in alone.values())
    probe = spark.createDataFrame([(1, "qwv zzyx vbn kjh zzyx qwv")], "doc_id long, text string")
    assert language_id.identify_languages(probe, language_id.learn_dictionaries(more)).first()["lang_pred"] == "rare"


def test_predictions_are_naive_compressions(spark):
    """The language is the one whose dictionary makes the sum of compressed chunks smallest."""
    import re
    import zstandard

    rng = random.Random(3)
    known = {"x": b"lorem ipsum dolor sit amet " * 40, "y": b"the quick brown fox jumps over " * 40, "z": "dès où été là ça ".encode() * 60}
    texts = [" ".join(rng.choice("lorem ipsum dolor the quick brown fox dès où été 12 !?".split()) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["", "12 !", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify_languages(df, known).collect():
        clean = "".join(c if c.isalpha() else " " for c in (texts[r["doc_id"]] or "").lower())
        clean = re.sub(" +", " ", clean).strip().encode()
        if not clean:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        sizes = {}
        for lang, raw in known.items():
            c = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(clean[i : i + 2048])) for i in range(0, len(clean), 2048))
        best = sorted(sizes.values())
        assert sizes[r["lang_pred"]] == best[0] and r["rejected"] == ((best[1] - best[0]) / best[0] < 0.01)


# ---- mixing


def test_mixing_is_the_sql(spark, sf):
    got = sorted(tuple(r) for r in queries.op2_mixing(spark, sf).collect())
    want = sorted(tuple(r) for r in oracle(sf, queries.SQL["op2_mixing"]))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def water_fill(sizes, weights, share=1.5, most=2.0):
    total, left, out = share * sum(sizes.values()), dict(weights), {}
    while left:
        level = (total - sum(out.values())) / sum(left.values())
        over = [k for k, w in left.items() if w * level > most * sizes[k]]
        if not over:
            return out | {k: w * level for k, w in left.items()}
        for k in over:
            out[k] = most * sizes[k]
            left.pop(k)
    return out


def test_targets_and_copies(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 60)), s) for i, s in enumerate(rng.choices(["a", "b", "B", "é", None, "tiny"], [50, 5, 10, 3, 8, 1], k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == 1500
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((k for k in sizes if k is not None)) + [None]
    want = water_fill(sizes, {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)})
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and 0 <= r["copies"] <= 2
    for k in names:
        taken = sum(r["taken"] for r in got if r["source"] == k)
        largest = max(r["size"] for r in got if r["source"] == k)
        assert abs(taken - want[k]) <= max(2 * largest, 0.02 * want[k])
    again = mixing.mix_sources(df.repartition(7)).select("row.doc_id", "copies").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_mixing_edges(spark):
    df = awkward(spark)
    mixed = mixing.mix_sources(df)
    assert mixed.count() == df.count()
    out = mixing.emit_mix(mixed)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixed.where("row.text IS NULL OR trim(row.text) = ''").where("size <> 0 OR taken <> 0").count() == 0
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.emit_mix(mixing.mix_sources(empty(spark))).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(blank).collect()} == {(0, 0.0, 0)}


# ---- licences


def test_licenses_are_the_sql(spark, sf):
    got = sorted((tuple(r) for r in queries.op3_licenses(spark, sf).select("doc_id", "digest", "n_chars", "license_id").collect()), key=str)
    assert got == sorted((tuple(r) for r in oracle(sf, queries.SQL["op3_licenses"])), key=str)


def test_license_forms(spark):
    mit = licenses.LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), mit.replace(",", " ;").replace(" ", "\n"), "Copyright 2011-2020 A. B.\nAll rights reserved.\n" + licenses.LICENSES["BSD-2-Clause"], mit + " And more.", "Released under the MIT Licence", None, "", "© 2020 X", "this sub-licence", "this sublicense"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, mit, "x")], "doc_id long, text string, digest string")
    rows = licenses.scan_licenses(df, licenses.license_table(spark)).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert [found[i]["license_id"] for i in range(len(texts))] == ["MIT", "MIT", "MIT", "BSD-2-Clause", None, "short-MIT", None, None, None, None, None]
    assert found[6]["digest"] is None and found[7]["digest"] is None and found[8]["digest"] is None and found[9]["digest"] == found[10]["digest"]
    assert licenses.scan_licenses(awkward(spark), licenses.license_table(spark)).count() == awkward(spark).count()
    assert licenses.scan_licenses(empty(spark), licenses.license_table(spark)).count() == 0


def test_license_files(spark):
    """Whole licence files with titles and holders in usual forms, clauses marked (c), and spellings that stand side by side."""
    L = licenses.LICENSES
    heads = ["MIT License\n\nCopyright (c) 2020 Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright © 2011-2019, Someone <a@b.c>\nCopyright (C) 2020 Another\n\n", "Copyright (c) 2020 X ", "Copyright 2020 Jane Doe. All rights reserved. ", "(c) 2019 A\n", "Copyright [yyyy] [name of copyright owner]\n", "MIT License Copyright (c) Jane Doe "]
    rows = [(i, h + L["MIT"], "MIT") for i, h in enumerate(heads)]
    rows += [(20, "BSD 3-Clause License\n\nCopyright (c) 2024, Jane\nAll rights reserved.\n\n" + L["BSD-3-Clause"], "BSD-3-Clause"), (21, "# Copyright 2020 Jane\n#\n" + "\n".join("# " + x for x in L["notice-Apache-2.0"].split("\n")), "notice-Apache-2.0"), (22, L["Unlicense"], "Unlicense"), (23, "ISC License\n\nCopyright (c) 2020 J\n\n" + L["ISC"], "ISC")]
    rows += [(30, "You may: (a) copy it; (b) lend it;\n(c) You may sell it.", None), (31, "You may: (a) copy it; (b) lend it;\n(c) You may NOT sell it.", None), (32, "licence licence whilst whilst", None), (33, "license license while while", None), (34, "sub licence sub licence", None), (35, "sublicense sublicense", None), (36, "the above copyright notice", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df, licenses.license_table(spark)).collect()}
    assert [found[i]["license_id"] for i, _, _ in rows] == [x for _, _, x in rows]
    assert found[30]["digest"] != found[31]["digest"] and found[32]["digest"] == found[33]["digest"] and found[34]["digest"] == found[35]["digest"] and found[36]["digest"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {(r[0], r[1], r[3]) for r in con.execute(queries.SQL["op3_licenses"]).fetchall()} == {(i, r["digest"], r["license_id"]) for i, r in found.items()}
    assert len({r["digest"] for r in licenses.license_table(spark).collect()}) == len(licenses.forms())


def test_copyright_statements(spark):
    """Statements without a year, long ones, those over two lines, and several; clauses that speak of copyright stay."""
    L = licenses.LICENSES
    names = ", ".join(f"Contributor Number{i} of Somewhere" for i in range(20))
    heads = ["Copyright The Foo Authors", "Copyright by X, 2020", f"Copyright (c) 2020 {names}", f"Copyright {names}", "Copyright (c) 2020 The Very Long\nFoundation for Names", "Copyright (c) 2019 A,\n  B,\n  and C", "© Jane", "(c) Copyright 2019 Jane"]
    heads += ["Copyright 2018 A\nCopyright 2019 B\nCopyright The C Authors\nCopyright 2020 D. All rights reserved.", " * Copyright Android Project", "Copyright 2020 The\nFoo Authors.\nAll rights reserved"]
    rows = [(i, f"{top}{h}\n\n{L['MIT']}", "MIT") for i, (top, h) in enumerate((t, h) for t in ("", "MIT License\n\n") for h in heads)]
    rows += [(100 + i, f"{h}\n{L['BSD-2-Clause']}", "BSD-2-Clause") for i, h in enumerate(heads)]
    wrapped = "\n".join(L["BSD-3-Clause"].replace("copyright notice", "\ncopyright notice").replace("COPYRIGHT HOLDER", "\nCOPYRIGHT HOLDER").split("\n"))
    rows += [(200, wrapped, "BSD-3-Clause"), (201, L["Unlicense"].replace("copyright interest", "\ncopyright interest").replace("copyright law", "\ncopyright law"), "Unlicense")]
    # What isn't a statement keeps its place, so that these are no licences.
    junk = "This text is about other things, at some length, so that nobody takes it for a name or for two of them; it goes on and on."
    rows += [(300, f"Copyright 2020 X\n{junk}\n\n{L['MIT']}", None), (301, f"Some words. Copyright 2020 X {junk} {junk} {junk}\n{L['MIT']}", None), (302, f"Copyright notice, to be read.\n\n{L['MIT']}", None), (303, f"(c) You may sell it.\n\n{L['MIT']}", None), (304, f"Copyright 2020 X\n\nA paragraph.\n\n{L['MIT']}", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(df, licenses.license_table(spark)).collect()}
    assert {i: found[i] for i, _, _ in rows} == {i: x for i, _, x in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {r[0]: r[3] for r in con.execute(queries.SQL["op3_licenses"]).fetchall()} == found


# ---- quality


def slow_counts(text):
    """The base counts, looked up place by place."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_counts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "d#", "é ", "\t", " \n", "a b c ", "\x0b", " ", "\x1c"]) for _ in range(rng.randint(0, 40)))
        words, *rest = quality_rules.base_counts(text)
        assert (len(words), *rest) == slow_counts(text)


def test_rules_keep_clean_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op10_quality_rules(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    for r in rows:
        n, chars, symbols, dup, rep = slow_counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])
    clean = [r["kept"] for r in rows if label.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if label.get(r["doc_id"]) == 0]
    assert np.mean(clean) >= 0.97 and np.mean(junk) <= 0.1


def test_rule_edges(spark):
    df = awkward(spark)
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert rows[40]["base_failed"] and rows[40]["n_words"] == 0 and not rows[41]["kept"] and rows[41]["nearest_lang"] is None
    assert quality_rules.quality_rules(df).count() == df.count()
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    kept = quality_rules.quality_rules(df, keep=True)
    assert kept.columns == df.columns and kept.count() == quality_rules.quality_rules(df).where("kept").count()
    alone = df.withColumn("lang", F.lit(None).cast("string"))
    assert quality_rules.quality_rules(alone).count() == df.count()
    assert quality_rules.js_distance(np.array([1, 0]), np.array([0, 1])) == 1 and quality_rules.js_distance(np.array([1, 2]), np.array([2, 4])) == 0


def script_prose(rng, first, n):
    """n words in the letters of a block of Unicode, with Latin full stops."""
    return " ".join("".join(chr(first + rng.randrange(24)) for _ in range(rng.randint(3, 9))) + rng.choice(["", "", "", "."]) for _ in range(n))


def test_rare_languages_keep_references(spark):
    """A non-Latin language far below 0.5 % of all words keeps its clean documents, with its own reference or, with few documents, a pooled one."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 9_000), "en") for i in range(40)]
    rows += [(100 + i, script_prose(rng, 0x430, 60), "ru") for i in range(25)]
    rows += [(200 + i, script_prose(rng, 0x3B1, 60), "el") for i in range(3)]
    rows += [(300, "#$% &*| <> 1!! " * 40, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(df)
    assert refs.langs == ["*", "en", "ru"]
    assert sum(len(t.split()) for _, t, lang in rows if lang == "ru") < 0.005 * sum(len(t.split()) for _, t, _ in rows)
    distance = {r["doc_id"]: r["class_distance"] for r in quality_rules.quality_rules(df).collect()}
    assert all(distance[i] <= 0.2 for i, _, lang in rows if lang != "en") and distance[300] > 0.2
    kept = {r["doc_id"] for r in quality_rules.quality_rules(df, keep=True).collect()}
    assert {i for i, _, lang in rows if lang in ("ru", "el")} <= kept and 300 not in kept


def test_rare_scripts_arent_blended(spark):
    """Three Cyrillic documents beside twelve of rare Latin languages, and sixty without any language, are kept; junk isn't, in whatever language."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 400), "en") for i in range(40)] + [(100 + i, prose(rng, 130), f"x{i}") for i in range(12)]
    junk = [(900, "#$% &*| <> 1!! " * 40, "en"), (901, "#$% &*| <> 1!! " * 40, None), (902, "a#$% &*| <> 1!! " * 40, "ru")]
    for lang, n in (("ru", 3), (None, 60), ("*", 3)):
        script = [(200 + i, script_prose(rng, 0x430, 130), lang) for i in range(n)]
        given = [r for r in rows + script + junk if r[2] != "ru" or lang == "ru"] + [(300, prose(rng, 130), None)]
        got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(given, "doc_id long, text string, lang string")).collect()}
        assert all(got[i]["kept"] for i, _, _ in given if i < 900)
        assert not any(got[i]["kept"] for i, _, _ in given if i >= 900)
    assert [quality_rules.script(t.encode()) for t in ("", "12 #", "abc дом", "дом a", "ελα", "中文字", "été")] == ["", "", "latin", "cyrillic", "greek", "east-asian", "latin"]


def test_references_of_many_even_languages(spark):
    """Of 250 languages with 0.4 % of the words each, and with 2 or 20 documents each, none is left untested."""
    rng = random.Random(6)
    for each, names in ((2, {"*"}), (20, {f"l{k:03d}" for k in range(250)})):
        rows = [(k * 100 + i, prose(rng, 60), f"l{k:03d}") for k in range(250) for i in range(each)] + [(10**6, "#$%&*|<> 1!! " * 60, None), (10**6 + 1, "".join(rng.choice("#$%&*|<>{}~ ") for _ in range(900)), "l001")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert set(quality_rules.references(df).langs) == names
        got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
        assert got[10**6 + 1]["n_words"] >= 50 and not got[10**6 + 1]["kept"] and got[10**6 + 1]["class_distance"] > 0.2
        assert all(got[i]["kept"] for i, _, _ in rows[:-2])


def test_verdicts_are_naive(spark):
    """Common words, references, distances and verdicts, counted in plain Python over all documents."""
    rng = random.Random(12)
    rows = [(i, (prose(rng, rng.randint(1, 120)) if i % 3 else script_prose(rng, 0x430, rng.randint(1, 90))) if i % 17 else rng.choice([None, "", "#$% &*| <> 1!! " * 30]), "en" if i % 3 else "ru") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    q = quality_rules
    counts, shares = {}, {}
    for _, t, lang in rows:
        if t:
            counts.setdefault(lang, Counter()).update(q.term(w) for w in t.split())
            if len(t.encode()) >= 200:
                c = q.class_histogram(t.encode())
                shares.setdefault(lang, []).append(c / c.sum())
    bins = sorted({w for c in counts.values() for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))[:40]})
    hist = lambda c: np.array([*(c[w] for w in bins), sum(c.values()) - sum(c[w] for w in bins)])
    medians = {k: np.array([(np.sort(np.rint(q.STEPS * np.sqrt(col)))[(len(col) + 1) // 2 - 1] / q.STEPS) ** 2 for col in np.array(v).T]) for k, v in shares.items()}
    for r in q.quality_rules(df).collect():
        t = rows[r["doc_id"]][1]
        n, _, _, _, rep = slow_counts(t)
        by_class = by_word = 0.0
        if t:
            by_class = min(q.js_distance(q.class_histogram(t.encode()), m) for m in medians.values())
            by_word = min(q.js_distance(hist(Counter(q.term(w) for w in t.split())), hist(c)) for c in counts.values())
        assert r["class_distance"] == pytest.approx(by_class, abs=1e-9) and r["word_distance"] == pytest.approx(by_word, abs=1e-9)
        sound = (not t or len(t.encode()) < 200 or by_class <= 0.2) and (n < 100 or by_word <= 0.6)
        assert r["kept"] == (sound and not (n < 50 or 100 * rep > 50 * n))


def test_distances_are_those_one_by_one():
    rng = np.random.default_rng(1)
    p, qs = rng.integers(0, 5, 30), rng.integers(0, 5, (7, 30))
    assert np.allclose(quality_rules.js_distances(p, qs / qs.sum(1, keepdims=True)), [quality_rules.js_distance(p, q) for q in qs], rtol=1e-12)


def test_classifier_held_out(spark, sf):
    rows = queries.op5_quality(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([p == y for p, y in held]) >= 0.9


def test_votes_are_brute_force():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = (rng.random(60) < 0.5).astype(float)
    model = quality_knn.Model(np.zeros(5, np.float32), np.eye(5, dtype=np.float32), v, y, 0.5)
    x = rng.normal(size=(20, 5)).astype(np.float32)
    for q, s in zip(x, model.score(x, neighbours=7)):
        c = v @ (q / np.linalg.norm(q))
        near = np.argsort(-c)[:7]
        w = np.maximum(c[near], 0) ** 8
        assert s == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-4)


def test_sample_size_keeps_the_mix(spark):
    """Votes weigh as each label's share of the labelled documents that are there, whatever the sample's bound; the smallest text of an id counts."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(90)] + [(0, "~ zzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(500)], "doc_id long, quality int")
    for sample in (5, 1500):
        model = quality_knn.fit(docs, labels, sample=sample)
        w = np.broadcast_to(model.weights, len(model.labels))
        assert model.prior == pytest.approx(0.9) and (w * model.labels).sum() / w.sum() == pytest.approx(0.9)
        assert len(model.labels) == (10 if sample == 5 else 90)


def test_classifier_edges(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, 0, 1), (5, None, 1), (6, 7, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(df, labels)
    rows = {r["doc_id"]: r for r in quality_knn.score_quality(df, model).collect()}
    assert rows[40]["score"] == rows[41]["score"] == rows[42]["score"] == 0 and 0 <= rows[43]["score"] <= 1
    assert quality_knn.score_quality(df, model).count() == df.count()
    none = quality_knn.fit(df, labels.limit(0))
    assert {r["score"] for r in quality_knn.score_quality(df, none).collect()} == {0.0, 0.5}
    assert quality_knn.score_quality(empty(spark), model).count() == 0
    kept = quality_knn.score_quality(df, model, keep=True)
    assert kept.columns == df.columns and kept.count() == quality_knn.score_quality(df, model).where("predicted = 1").count()
    assert quality_knn.fit(empty(spark), labels).labels.size == 0


# ---- the pipeline


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    tokens = pieces.agg(F.sum("length")).first()[0]
    assert tokens == queries.token_counts.count_tokens(docs, queries.bpe_path()).agg(F.sum(F.col("n_tokens") + 1)).first()[0]


def test_stages_take_awkward_and_empty_tables(spark, sf):
    for docs in (awkward(spark), empty(spark)):
        docs = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert "sequence_id" in docs.columns


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and [c for c in DOCS.split(", ")]
