"""Operators 2, 3, 4, 9 and 10 against brute force on small tables."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loamgraph.llm import chat_format, licenses, pii, quality_rules, toxicity
from loamgraph.llm.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n", "one", "a b a b a b", "x\x0by\x0cz\r\nx y z", "é" * 70000, "ab " * 30000, "line one\nline one\n\n \nline one", " wide space # * $ %"]


def brute_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rule_counts_equal_brute_force(spark):
    docs = docs_of(spark, enumerate(ODD))
    got = {r["doc_id"]: tuple(r)[1 : 1 + len(quality_rules.COUNTS)] for r in quality_rules.rule_statistics(docs).collect()}
    for i, text in enumerate(ODD):
        assert got[i] == brute_rules(text), i


def test_quality_keeps_good_and_rejects_labelled_junk(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)) + ".") for i in range(240)]
    junk = [(1000 + i, " ".join(f"###{(i + 3 * k) % 991}$$$|{k}" for k in range(80))) for i in range(20)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert not any(kept[i] for i, _ in junk) and sum(kept[i] for i, _ in good) >= 0.95 * len(good)


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 60, " ".join(f"{'#$|' if i % 3 == 0 and i < 60 else 'word'}{(i * 7 + k * k) % 97}" for k in range(80))) for i in range(120)]  # two texts for each id
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows).withColumn("n_words", F.lit("own")).withColumn("kept", F.lit(1))
    want = sorted(map(str, quality_rules.judge(docs, labels).collect()))
    assert sorted(map(str, quality_rules.judge(docs_of(spark, rows[::-1]).repartition(5), labels).collect())) == want


def test_quality_of_rows_whose_labels_are_hidden(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = quality_rules.judge(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").where("not base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    share = {r["quality"]: r["kept"] / r["n"] for r in out}
    assert share[1] >= 0.95 and share[0] <= 0.2


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = docs_of(spark, [*enumerate(ODD), (None, "x " * 60), (0, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, none).collect()
    assert len(out) == len(ODD) + 2 and not any(r["kept"] for r in out if r["n_words"] < 50)
    assert quality_rules.judge(docs.limit(0), none).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    def luhn(s):
        return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    ]


@pytest.mark.parametrize("seed", range(30))
def test_base_spans_equal_the_plain_patterns(seed):
    import random

    rng = random.Random(seed)
    bits = ["a", "Z9", "@", ".", "-", "+1", " ", "12", "4111 1111 1111 1111", "255.1.2.3", "1.2.3.4.5.6.7.8", "x@y.co", "(", ")", "é", "\n", "999", "_", "4111-1111-1111-1111-1"]
    text = "".join(rng.choice(bits) for _ in range(300))
    assert pii.base_spans(text) == brute_pii(text)


def test_base_spans_stay_linear_on_long_runs():
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 60_000):
        pii.base_spans(run)


def test_disclosing_terms_and_digest(spark):
    rows = [(i, f"zeldaxyz wrote from zed@ex.org about item {i}") for i in range(4)] + [(10 + i, f"about item {i} they wrote from home") for i in range(20)] + [(90, None), (91, ""), (None, "ip 1.2.3.4")]
    found = pii.find(docs_of(spark, rows), threshold=0.9, support=3)
    out = {r["doc_id"]: r for r in pii.digests(found).collect()}
    assert len(out) == len(rows)
    assert out[0]["n_email"] == 1 and out[0]["spans"] == "email:20:30,term:0:8"
    assert out[0]["base_sha256"] == hashlib.sha256(b"email:20:30").hexdigest()
    assert out[10]["spans"] == "" and out[90]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[None]["n_ip"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, rows), threshold=0.9, support=3).collect()}
    assert clean[0] == " wrote from [EMAIL] about item 0" and clean[10] == rows[4][1] and clean[90] is None
    assert pii.find(docs_of(spark, []).limit(0)).count() == 0


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"Zeldaxyz heads this page {far} zed@ex.org {far} signed zeldaxyz") for i in range(20)]
    rows += [(100, f"only zeldaxyz is named {far}"), (None, "a zeldaxyz, ZELDAXYZ"), (None, "a zeldaxyz, ZELDAXYZ"), (None, "another text")]
    rows += [(200 + i, f"heads this page is named only a another signed text {far}") for i in range(400)]
    found = [(r["doc_id"], r["spans"]) for r in pii.digests(pii.find(docs_of(spark, rows), threshold=0.9, support=3)).collect()]
    assert len(found) == len(rows)
    spans = dict(found)
    text = rows[0][1]
    at, last = text.index("zed@ex.org"), text.rindex("zeldaxyz")
    assert spans[0] == f"email:{at}:{at + 10},term:0:8,term:{last}:{last + 8}"
    assert spans[100] == "term:5:13" and spans[200] == ""
    assert sorted(y for x, y in found if x is None) == ["", "term:2:10,term:12:20", "term:2:10,term:12:20"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, rows), threshold=0.9, support=3).collect()}
    assert "zelda" not in clean[0].lower() and clean[100] == f"only [TERM] is named {far}" and clean[200] == rows[-400][1]


def test_forms_and_classes_disclose(spark):
    rows = [(i, f"page with access token = {'%040x' % (i * 7919 + 1)} and {'mail' if i % 2 else 'post'} who{i}@mail{i % 3}.example.com said") for i in range(30)]
    rows += [(100, f"page with access token = {'%040x' % 77} only"), (101, "")]
    rows += [(200 + i, f"page with access and mail or post said only {i} words") for i in range(600)]
    out = {r["doc_id"]: r for r in pii.digests(pii.find(docs_of(spark, rows))).collect()}
    at = rows[30][1].index("token")
    assert out[100]["spans"] == f"term:{at}:{at + 5},term:{at + 8}:{at + 48}" and out[100]["n_spans"] == 2
    assert all(out[i]["n_term"] == 2 and out[i]["n_email"] == 1 for i in range(30)) and out[200]["spans"] == out[101]["spans"] == ""
    clash = docs_of(spark, rows + rows[:2]).withColumn("term", F.lit("own")).withColumn("terms", F.lit(1)).withColumn("rid", F.lit(2))
    clean = pii.sanitise(clash)
    texts = [r["text"] for r in clean.where("doc_id in (0, 100)").collect()]
    assert clean.columns == clash.columns and clean.count() == len(rows) + 2 and len(texts) == 3
    assert all("token" not in t and "%040x" % 77 not in t for t in texts)


def brute_disclosure(rows, support=3):
    docs = []
    for _, text in rows:
        spans = pii.base_spans(text or "")
        terms = {pii.term_of(text[s:e]) for s, e in pii.terms_outside(text or "", spans)}
        docs.append((pii.entities_of(text or "", spans), terms))
    n, every = len(docs), {t for _, terms in docs for t in terms}
    entities = {e for own, _ in docs for e in own}
    count = lambda e, t: sum((e is None or e in own) and (t is None or t in terms) for own, terms in docs)
    out = {}
    for e in entities:
        n_e = count(e, None)
        for t in every if support <= n_e < n else ():
            both, n_t = count(e, t), count(None, t)
            if both >= support:
                pmi = math.log(n * both / (n_e * n_t))
                if round(pmi / math.log(n / n_e), 9) >= 0.9 and both * pmi >= math.log(len(every)):
                    out[e, t] = pmi / math.log(n / n_e)
    return out


def test_disclosure_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    bits = ["x@a.org", "y@a.org", "1.2.3.4", "1.2.9.9", "4111 1111 1111 1111", "+1 555 123 4567"]
    rows = []
    for i in range(160):
        words = [f"w{rng.randint(0, 30)}x".replace("1", "one") for _ in range(6)]
        if i % 8 == 0:
            k = rng.randrange(len(bits))
            words += [bits[k], f"near{'abcdef'[k]}", "signed"]
        rows.append((i, " ".join(words)))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing(pii.read_texts(docs_of(spark, rows)), threshold=0.9, support=3).collect()}
    want = {(pii._hash(e), pii._hash(t)): x for (e, t), x in brute_disclosure(rows).items()}
    assert set(got) == set(want) and len(want) > 3 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_licenses(spark):
    rows = [(0, "Intro text here.\nReleased under the MIT License.\nmore"), (1, "plain prose without anything of the kind " * 5), (2, None), (3, ""), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "He has a driving license and all of his rights."), (6, "Licensed under CC BY-NC 4.0.")]
    docs = docs_of(spark, rows)
    out = {r["doc_id"]: r["license"] for r in licenses.document_licenses(licenses.scan(docs, licenses.train(docs))).collect()}
    assert out == {0: "mit", 1: "none", 2: "none", 3: "none", 4: "gpl", 5: "none", 6: "cc-by-nc"}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation"""
SHARE = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0\nInternational License."


def test_wrapped_licenses_and_titles(spark):
    prose = "ordinary words of a story that goes on\n" * 30
    rows = [(0, MIT), (1, prose + BSD), (2, GPL + "\n" + prose), (3, LGPL), (4, SHARE), (5, "MIT License\n\ntext of something"), (6, "BSD 3-Clause License"), (7, "They wrote about the MIT License and\nthe BSD 3-Clause License in general."), (8, prose), (9, MIT.replace("\n", " ") + " " + BSD.replace("\n#", "") + " " + prose.replace("\n", " "))]
    docs = docs_of(spark, rows)
    found = licenses.scan(docs, licenses.train(docs)).cache()
    out = {r["doc_id"]: r["license"] for r in licenses.document_licenses(found).collect()}
    assert out == {0: "mit", 1: "bsd", 2: "gpl", 3: "lgpl", 4: "cc-by-sa", 5: "mit", 6: "bsd", 7: "none", 8: "none", 9: "bsd,mit"}
    at = {r["doc_id"]: [x["line"] for x in r["found"] if x["confirmed"]] for r in found.collect()}
    assert at[0] == [0] and at[1] == [30] and at[2] == [0]


UNSEEN = [
    ("mit", "This library is released under the MIT License."), ("mit", "Code licensed under the terms of the MIT license"),
    ("apache", "Licensed under Apache License, Version 2.0"), ("apache", "It is licensed under the Apache License Version 2.0 by its authors"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."), ("gpl", "The text is licensed under the GNU General Public License, version 3 or later."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"), ("bsd", "Licensed under a BSD 3-Clause License"),
    ("mpl", "Licensed under the Mozilla Public License, Version 2"), ("cc-by", "This text is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Pictures licensed under CC BY-SA 4.0 by the museum"), ("cc-by-nc", "Licensed under CC BY-NC 4.0, no sale"),
    ("cc0", "dedicated to the public domain under CC0"), ("proprietary", "Copyright 2023 by the publisher. All rights reserved."),
]
PLAIN = [
    "All rights to free lunch are reserved by the chef.", "He has a driving license and all of his rights.", "The public library is free for any person who can read.",
    "Permission was granted to the general public to use the copy room.", "A version of this work is in the domain of art.", "They shared the creative attribution of the common work.",
]


def test_unseen_notices_are_told_from_prose():
    model = licenses.Classifier(["an ordinary sentence of plain words that says nothing at all"] * 50)
    confirmed = lambda text: [f for _, f, _, s in model.scan(text) if s >= 0.7]
    right = [confirmed(text) == [family] for family, text in UNSEEN]
    assert sum(right) >= 0.9 * len(right), [t for t, ok in zip(UNSEEN, right) if not ok]
    assert not any(confirmed(text) for text in PLAIN)
    assert model.scan("Licensed under the EUPL, Version 1.2.") and not confirmed("Licensed under the EUPL, Version 1.2.")
    assert model.scan("") == model.scan(None) == [] and confirmed("word " * 50_000 + "\n" + UNSEEN[0][1]) == ["mit"]


def test_license_scan_of_odd_tables(spark):
    docs = docs_of(spark, [(1, UNSEEN[0][1]), (1, UNSEEN[0][1]), (None, UNSEEN[0][1]), (2, None), (3, "")]).withColumn("found", F.lit("own")).withColumn("license", F.lit(1))
    model = licenses.train(docs)
    out = licenses.document_licenses(licenses.scan(docs, model)).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in out) == [("1", "mit"), ("1", "mit"), ("2", "none"), ("3", "none"), ("None", "mit")]
    assert licenses.document_licenses(licenses.scan(docs.limit(0), licenses.train(docs.limit(0)))).count() == 0


def test_classifier_knows_its_templates_and_unseen_variants():
    model = licenses.Classifier(["an ordinary sentence of plain words that says nothing at all"] * 50)
    for family, own in licenses.TEMPLATES.items():
        for text in own:
            assert model.predict(licenses.words_of("see here " + text))[0] == family


TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_reply_tree_paths(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "ok", 0.9), (1, 5, 4, "assistant", None, 0.9), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (3, 7, 99, "user", "orphan", None), (3, 7, 99, "user", "orphan", 5.0), (None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), (None, None, 1, "user", "no node", 0.0)]
    tree = spark.createDataFrame(rows, TREE)
    got = {(r["conv_id"], r["path"]): chat_format.parse(r["formatted"]) for r in chat_format.format_paths(tree, top=2).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "good"), ("user", "ok"), ("assistant", "")], (1, 2): [("user", "q"), ("assistant", "bad")], (3, 1): [("user", "orphan")], (None, 1): [("user", "a"), ("assistant", "b")]}
    clash = tree.withColumn("conv", F.lit(1)).withColumn("path", F.lit(2)).withColumn("depth", F.lit(3))
    assert chat_format.format_paths(clash).count() == 3 and chat_format.format_paths(tree.limit(0)).count() == 0
    assert chat_format.digests(chat_format.format_paths(tree.limit(0))).count() == 0


def test_format_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\n", "<\\|im_end|>", "[\\\\INST]", "<" + "<|im_start|>", "", "a\\b\nc", None, "日本" * 500]
    rows = [(9, k, ["user", "assistant", "sys\n\\tem<|im_end|>"][k % 3], t) for k, t in enumerate(nasty)] + [(8, 0, "user", "x"), (8, 0, "user", "x"), (None, 0, "user", "y"), (None, 1, "assistant", "z"), (0, 0, "user", "zero")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_paths(chat_format.linear_tree(df))
    out = {r["conv_id"]: r for r in formatted.collect()}
    assert chat_format.parse(out[9]["formatted"]) == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert out[8]["n_turns"] == 2 and set(out) == {None, 0, 8, 9}
    assert chat_format.parse(out[None]["formatted"]) == [("user", "y"), ("assistant", "z")] and chat_format.parse(out[0]["formatted"]) == [("user", "zero")]
    d = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}[9]
    loss = "".join(t or "" for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(nasty)])
    assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (d["n_turns"], d["turns_sha256"]) == (len(nasty), hashlib.sha256(said.encode()).hexdigest())
    for marker in ("<|im_start|>", "<|im_end|>"):
        assert out[9]["formatted"].count(marker) == len(nasty)


def test_chat_query_holds_all_conversations(spark, sf_dir):
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert QUERIES["op9_reply_tree_chat"](spark, sf_dir).count() == told + 1


def test_ratio_tables_equal_brute_force(spark):
    rows = [("bad idiot words", 1), ("bad moron idiot", 1), ("fine words here", 0), ("", 0), ("some fine prose", 0)]
    train = spark.createDataFrame(rows, "text string, toxic int")
    n, docs_with = toxicity.ORDER, [{}, {}]
    for text, label in rows:
        padded = b"\0" * (n - 1) + toxicity.folded(text.encode())
        for g in {padded[i : i + n] for i in range(len(padded) - n + 1)}:
            docs_with[label][g] = docs_with[label].get(g, 0) + 1
    got = {r["key"].to_bytes(n, "big"): (r["toxic_n"], r["plain_n"]) for r in toxicity.count_grams(train).collect()}
    assert got == {g: (docs_with[1].get(g, 0), docs_with[0].get(g, 0)) for g in {*docs_with[0], *docs_with[1]}}
    ratios = {r["key"].to_bytes(n, "big"): r["ratio"] for r in toxicity.log_ratios(toxicity.count_grams(train)).collect()}
    d, types = toxicity.DISCOUNT, {m: {g[-m:] for g in got} for m in range(1, n + 1)}

    def shared(g):  # interpolated Kneser-Ney over the numbers of different left neighbours
        m = len(g)
        if not m:
            return 1 / 256
        left = lambda x: sum(t[1:] == x for t in types[m + 1])
        own = [x for x in types[m] if x[:-1] == g[:-1]]
        total = sum(map(left, own))
        return max(left(g) - d, 0) / total + d * len(own) / total * shared(g[1:])

    def p(label, g):
        c = docs_with[label]
        own = [c[x] for x in c if x[:-1] == g[:-1]]
        weight = d * len(own) / sum(own) if own else 1.0
        return max(c.get(g, 0) - d, 0) / max(sum(own), 1) + weight * shared(g[1:])

    assert set(ratios) == set(got) and ratios[b"idiot"] > 0
    for g, ratio in ratios.items():
        assert ratio == pytest.approx(math.log(p(1, g) / p(0, g)), abs=1e-9)


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    plain = [(i, " ".join(f"w{(i * 31 + k * k) % 89}" for k in range(60))) for i in range(400)]
    toxic = [(1000 + i, " ".join(f"w{(i * 17 + k * k) % 89}" for k in range(30)) + " you idiot moron " + " ".join(f"w{k}" for k in range(20))) for i in range(120)]
    docs = docs_of(spark, plain + toxic + [(5000, ""), (5001, None), (None, "x")])
    truth = {i: 0 for i, _ in plain} | {i: 1 for i, _ in toxic}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = lambda flip: spark.createDataFrame([(i, 1, 1 - y if flip and i in held else y) for i, y in truth.items()], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels(False)).collect()}
    assert len(out) == len(truth) + 3 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(out[i]["held_out"] == (i in held) for i in truth)
    assert sum(out[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels(True)).collect()}
    assert again == {i: r["score"] for i, r in out.items()}


def test_tables_hold_every_ngram_and_no_other(spark):
    rows = [((k * 7919 * 7919 + 5) % (1 << 40), (k % 31 - 15) / 8) for k in range(40_000)]
    table = toxicity._packed(spark.createDataFrame(rows, "key long, ratio double"))
    keys = toxicity.np.array([r[0] for r in rows])
    assert len(set(keys.tolist())) == len(rows)
    assert table.find(keys).tolist() == [r[1] for r in rows]
    strange = toxicity.np.array(sorted({int(k) ^ 1 for k in keys} - set(keys.tolist())))
    assert toxicity.np.isnan(table.find(strange)).all() and len(strange) > 10_000
    none = toxicity._packed(spark.createDataFrame([], "key long, ratio double"))
    assert toxicity.np.isnan(none.find(keys)).all()


def test_joined_tables_score_as_broadcast_ones(spark):
    docs = docs_of(spark, [(i, ("you idiot " if i % 3 == 0 else "fine words ") + f"w{i}") for i in range(240)] + [(None, None), (77, ""), (78, "é idiot " * 300)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    scores = [dict((r["doc_id"], r["score"]) for r in toxicity.fit(docs, labels, most_grams=m).score(docs).collect()) for m in (0, 1 << 20)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6) and len({round(s, 6) for s in scores[0].values()}) > 5


def test_toxicity_of_odd_tables(spark):
    rows = [(i, ("you idiot " if i % 2 else "fine words ") + f"w{i}") for i in range(60)] + [(3, "you idiot w3"), (None, "x"), (99, "long " * 300_000)]
    docs = docs_of(spark, rows).withColumn("mean", F.lit("own")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] * 2 + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0 and toxicity.score_documents(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a b"), (2, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score_documents(docs, none).collect()] == [0, 0]
    assert toxicity.reject(docs.withColumn("score", F.lit("own")), none).columns == [*docs.columns, "score"]
