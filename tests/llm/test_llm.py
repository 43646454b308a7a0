"""Training-data operators against brute force, stated cases, round trips and held-out accuracy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimlake.llm import areas, components, leakage, packing, sentences
from claimlake.sources.tables import table

SMALL = "/root/testdata/sf0.01"


# --- groups of matches -------------------------------------------------------------------------------------------------


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [100_000, 5])
def test_groups_against_union_find(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    rng = random.Random(5)
    edges = [(f"{rng.randrange(300):03}", f"{rng.randrange(300):03}") for _ in range(150)]
    edges += [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("zz", f"h{i:03}") for i in range(80)] + [("self", "self")]
    kinds = ["corroborates", " CORROBORATES", "Corroborates "]
    data = [(a, b, kinds[i % 3], 1) for i, (a, b) in enumerate(edges)] + [(b, a, "corroborates", 1) for a, b in edges[:20]]
    data += [("000", "p00", "contradicts", 1), (None, "p05", "corroborates", 1), ("p06", "", "corroborates", 1), ("q", None, "corroborates", 1), ("q", "r", None, 1)]
    df = spark.createDataFrame(data, "left_id string, right_id string, relation string, group_id int")
    assert {r["fact_id"]: r["group_id"] for r in components.consolidate(df).collect()} == brute_groups(edges)
    assert components.consolidate(df.limit(0)).count() == 0


def test_groups_of_the_table(spark):
    rel = table(spark, SMALL, "relations")
    edges = [tuple(r) for r in rel.where("lower(trim(relation)) = 'corroborates' and length(trim(left_id)) > 0 and length(trim(right_id)) > 0").select("left_id", "right_id").collect()]
    assert {r[0]: r[1] for r in components.consolidate(rel).collect()} == brute_groups(edges)


# --- sentences ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "parts",
    [
        ["Mr. A. K. Smith of Orrin Pvt. Ltd. paid Rs. 5 Cr. in May."],
        ["It rose to 2.5 p.a.", "Version 2.3 applies.", "It opens at 9 a.m.", "319.8 Cr. was the volume."],
        ["They settled on plan B.", "Orrin grew.", "See Sec. 4.2.", "Reg. 7.1 (iv) applies, cf. Sched. II.", "He left."],
        ['He asked, "Why is it so? Who pays?" and left.', '"No comment."', '"We rose. We fell," said Dr. Zin.', "Costs rose, fell ...", "eFleet, a unit, grew."],
        ["Is that all?", "Really?!", "(It is not.)", "'Not yet.'", "Output was 5 Mn Tons ... and stayed; (a) late, (b) early."],
        ["The board met on 14 Mar. 2024 and rose at 6.30 p.m.", "Filing closed in Dec.", "Ms. Lin et al. dissented."],
        ["Der Ausschuss tagte am 3. Mai 2022.", "Die Marge stieg, u. a. wegen der Maut, auf 9,9 Mio. EUR.", "„Wir sind da. Das reicht nicht“, sagte Dr. Wick.", "Fiel er im 2. Quartal 2019?"],
        ["Laut Abs. 3 Nr. 3 sind es bis zu 4 %.", "Siehe Art. 5 Nr. 12.", "The spread rose by 6.4 pp.", "12 banks agreed."],
        ["El Sr. Dor dijo: «Cerramos. No es poco».", "¿Y después?", "Según el art. 13, es de aprox. 4 % (véase pág. 3).", "El acta es la núm. 4."],
        ["Le conseil s'est réuni à 18 h.", "« Ce n'est pas assez », dit M. Quil.", "Quelle hausse !", "Au 1er avr. 2020, rien."],
        ["धारा 8.2 के अनुसार 3.1 करोड़ है।", 'डॉ. Dor ने कहा, "यह है। यह नहीं।"', "क्या 2021 में?"],
        ["هل تراجعت في 2020؟", 'قال د. Dor: "وصلنا. لا يكفي."', "الأرقام غير مدققة."],
    ],
)
def test_sentences_joined_by_blanks_come_apart_again(parts):
    for glue in (" ", "  ", "\n", "\n\n"):
        text = glue.join(parts)
        assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("監査は済んでいない。Dor氏は「増えた。まだだ。」と述べた。次は何か？", ["監査は済んでいない。", "Dor氏は「増えた。まだだ。」と述べた。", "次は何か？"]),
        ("“只有73.9万件。这还不够。”Dor说。数据未经审计；其余另计。", ["“只有73.9万件。这还不够。”Dor说。", "数据未经审计；其余另计。"]),
        ("รายได้เหลือ1,260.4 ล้านดอลลาร์แล้ว ตัวเลขนี้ยังไม่ผ่าน อยู่ที่34.3% รายได้ดี", ["รายได้เหลือ1,260.4 ล้านดอลลาร์แล้ว", "ตัวเลขนี้ยังไม่ผ่าน", "อยู่ที่34.3%", "รายได้ดี"]),
        ("  Table 3 (Rs. crore)\n\nNet loss (Nos. in million) 12 (4)\n \nIn FY24.No. 5 grew.It fell.\n", ["Table 3 (Rs. crore)", "Net loss (Nos. in million) 12 (4)", "In FY24.", "No. 5 grew.", "It fell."]),
        ("Paid 5 Cr. INR in May. Paid 5 Cr. INR 7 was more. See www.x.example/f.aspx?id=2.9 for it.", ["Paid 5 Cr. INR in May.", "Paid 5 Cr.", "INR 7 was more.", "See www.x.example/f.aspx?id=2.9 for it."]),
    ],
)
def test_sentences_of_other_scripts(text, parts):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["Սա առաջինն է։", "Սա երկրորդն է։"], ["ይህ የመጀመሪያው ነው።", "ሁለተኛው ነው፧", "ሦስተኛው ነው።"], ["ဒါက ပထမ။", "ဒါက ဒုတိယ။"], ["នេះគឺមួយ។", "នេះគឺពីរ៕"],
        ["འདི་དང་པོ་ཡིན། །", "འདི་གཉིས་པ་ཡིན།"], ["ᠨᠢᠭᠡ ᠪᠣᠯᠤᠨᠠ᠃", "ᠬᠣᠶᠠᠷ ᠪᠣᠯᠤᠨᠠ᠉"], ["ܗܢܐ ܩܕܡܝܐ܂", "ܗܢܐ ܬܪܝܢܐ܁"], ["売上は３．５億円．", "次は４億円．"], ["One came﹒", "Two left﹒"],
        ["It grew‼", "Did it⁇", "So it did⁈", "It fell⁉", "Well."], ["“Did it⁇” he asked.", "It did."], ["ᱱᱚᱶᱟ ᱢᱤᱫ᱾", "ᱱᱚᱶᱟ ᱵᱟᱨ᱿"], ["ꯃꯁꯤ ꯑꯃꯅꯤ꯫", "ꯃꯁꯤ ꯑꯅꯤꯅꯤ꯫"],
    ],
)
def test_terminators_of_all_scripts(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts
    close = "売上は３．５億円．次は４億円．"
    assert [close[a:b] for a, b in sentences.sentence_spans(close)] == ["売上は３．５億円．", "次は４億円．"]


def test_classes_are_those_of_the_property():
    assert {"։", "።", "။", "។", "།", "。", "؟", "।"} <= set(sentences.FULL) and set(".․﹒．") == set(sentences.STOPS) and sentences.STOPS[0] == "."
    assert {")", "]", "”", "»", "」", '"', "'"} <= set(sentences.CLOSING) and not {"(", "“", "「"} & set(sentences.CLOSING)
    assert {",", ";", ":", "、", "，", "；", "：", "،"} <= set(sentences.GOES_ON) and "-" not in sentences.GOES_ON
    assert len(sentences.sentence_spans("He came.﹚ He went! ، and so on.")) == 2


def test_sentence_table(spark):
    assert sentences.sentence_spans(None) == sentences.sentence_spans("") == sentences.sentence_spans(" \n ") == []
    long = "One more sentence here. " * 30_000
    assert len(sentences.sentence_spans(long)) == 30_000
    df = spark.createDataFrame([("a", "One. Two here.", 1), ("a", "One. Two here.", 2), ("b", "One.", 1), ("c", None, 1), (None, "X. Y.", 1), ("d", "", 1)], "k string, t string, sent_start int")
    got = sorted(map(tuple, sentences.split_sentences(df, F.col("k"), "t", "f").collect()))
    assert got == [("f", "a", 0, 4), ("f", "a", 5, 14), ("f", "b", 0, 4)]
    assert sentences.split_sentences(df, F.col("k"), "t", "f", least=2).count() == 2 and sentences.split_sentences(df.limit(0), F.col("k"), "t", "f").count() == 0


def test_sentences_of_the_pages_cover_their_text(spark):
    for r in table(spark, SMALL, "pages", "text").collect():
        spans = sentences.sentence_spans(r["text"])
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(r["text"][a:b] for a, b in spans).split() and "".join("".join(r["text"][a:b] for a, b in spans).split()) == "".join(r["text"].split())


# --- containers --------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.geometric(1 / 300, 5000), 2048)
    boxes = packing.pack(sizes, 2048)
    fill = np.bincount(boxes, sizes)
    assert fill.max() <= 2048 and fill.min() > 0 and fill.sum() == sizes.sum() and len(fill) <= 1.01 * -(-sizes.sum() // 2048) + 2
    assert packing.pack(np.array([], int), 8).tolist() == [] and packing.pack(np.array([8, 3, 5, 8]), 8).tolist() == [0, 1, 1, 2]


def test_containers_of_documents(spark):
    data = [(i, n) for i, n in enumerate([5, 2048, 2049, 10_000, 1, 1, 700, 0])] + [(99, None), (6, 700)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long").withColumn("container", F.lit("clash"))
    for parts in (1, 5):
        got = packing.fill_containers(df.repartition(parts)).collect()
        pieces = {}
        for r in got:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        assert sum(r["n_tokens"] for r in got) == sum(n for _, n in data if n) and 7 not in pieces and 99 not in pieces
        assert sorted(pieces[3]) == [(k, 2048 * k, 2048 if k < 4 else 10_000 - 8192) for k in range(5)] and pieces[1] == [(0, 0, 2048)] and len(pieces[6]) == 2
        room = {}
        for r in got:
            room[r["shard"], r["container"]] = room.get((r["shard"], r["container"]), 0) + r["n_tokens"]
        assert max(room.values()) <= 2048
        rows = sorted(map(tuple, got))
        assert rows == (first := rows if parts == 1 else first)  # noqa: F821
    assert packing.fill_containers(df.limit(0)).count() == 0


def test_token_counts():
    count = lambda t: packing.token_count(t, "/opt/tokenizers")
    assert count(None) == count("") == 0 and count("Hello world") == 2 and count("<|endoftext|>") > 1
    long = "some words and more, " * 20_000
    assert abs(count(long) - 20_000 * count(" some words and more,")) <= 20_010


@pytest.mark.parametrize("text", ["a" * 250_000, "word " * 60_000, " " * 150_000 + "x" + "\n" * 150_000, "x \n\ty" * 60_000, "12.5%," * 50_000, "ab1?" * 60_000 + " end", "!\x1c" * 90_000, " " * 60_000 + "\n" + " " * 60_000])
def test_long_texts_are_counted_as_a_whole(text):
    whole = packing._encoding("/opt/tokenizers", packing.VOCABULARY).encode_ordinary(text)
    assert packing.token_count(text, "/opt/tokenizers") == len(whole)


def test_very_long_runs_of_blanks_are_counted():
    assert packing.token_count(" " * 2_000_000 + "x", "/opt/tokenizers") > 1 and packing.token_count("\n" * 2_000_000, "/opt/tokenizers") > 0


def test_breaches_are_counted(spark):
    schema = "doc_id long, piece long, first_token long, n_tokens long, shard int, container long"
    sound = [(1, 0, 0, 10, 0, 0), (1, 1, 10, 10, 0, 1), (1, 2, 20, 3, 0, 2), (2, 0, 0, 7, 0, 2)]
    assert packing.breaches(spark.createDataFrame(sound, schema), 10).first() == (2, 0, 0, 0)
    wrong = [(1, 0, 0, 10, 0, 0), (1, 2, 20, 3, 0, 0), (2, 0, 0, 3, 0, 1), (2, 1, 3, 4, 0, 1), (3, 0, 0, 4, 0, 1)]
    assert packing.breaches(spark.createDataFrame(wrong, schema), 10).first() == (3, 2, 1, 2)


def test_container_report(spark):
    r = entry.queries()["p6_report"](spark, SMALL).first()
    assert r["utilisation"] > 0.97 and r["tokens"] + r["room"] == r["containers"] * 2048


# --- leaks -------------------------------------------------------------------------------------------------------------

ITEM = "Read this.\nIn 1904 the brittle parcel hub passed from Zinmereby to Ostfordsk, half-finished and 12,345 lighter, as rail crews auctioned it twice over. No quiet truck survived.\nQuestion: How many amber items had Zinmereby reopened once Ostfordsk sealed the dock?\nAnswer: 7"


def leaks(text, run=20):
    shared = leakage.Shared(frozenset(["Read this."]), {k: tuple(v.split()) for k, v in leakage.hyphened(ITEM).items()})
    index = leakage.index_items([(1, ITEM), (2, None), (3, "")] + [(10 + i, f"Read this.\nAnother item number {i} altogether.") for i in range(9)], shared)
    return {index.ids[r] for r, n in leakage.leaked_items(text, index).items() if n >= run}


def test_leaks_in_disguise():
    body = ITEM.split("\n")[1]
    assert leaks(f"Before. {body} After.") == {1} and leaks(body.upper()) == {1} and leaks("Read this. Read this. Read this.") == set()
    assert leaks(body.replace("auctioned", "auc-\ntioned").replace("brittle", "brit­tle").replace(",", "").replace("half-finished", "half-\nfinished")) == {1}
    assert leaks("<p>" + body.replace(" the ", " <b>the</b>&nbsp;").replace("12,345", "１２,３４５") + "</p>") == {1} and leaks(body.replace("half-finished", "halffinished")) == {1}
    words = body.split()
    assert leaks(" ".join("another" if i in (5, 15) else w for i, w in enumerate(words))) == {1}
    assert leaks(" ".join("another" if i % 4 == 0 else w for i, w in enumerate(words))) == set()
    assert leaks(" ".join(words[:12])) == set() and leaks(" ".join(words[8:]) + " How many amber items had") == {1} and leaks(None) == leaks("") == set()


def brute_run(agree):
    best = 0
    for a in range(len(agree)):
        for b in range(a, len(agree)):
            n = b - a + 1
            if agree[a] and agree[b] and n - sum(agree[a : b + 1]) <= n // 10:
                best = max(best, n)
    return best


def test_longest_run_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        agree = np.array([rng.random() < rng.choice([0.5, 0.85, 0.95]) for _ in range(rng.randrange(0, 60))], bool)
        assert leakage.longest_run(agree) == brute_run(agree.tolist())


def test_leaks_of_a_table(spark, monkeypatch):
    body = ITEM.split("\n")[1]
    docs = spark.createDataFrame([(1, "x " * 50_000 + body, 5), (2, body, 5), (3, body, 5), (4, None, 5), (5, "", 5), (6, "nothing", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None)], "item_id long, text string")
    expected = [(1, 1), (2, 1), (3, 1)]
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == expected
    monkeypatch.setattr(leakage, "ITEM_CHARS", 100)
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == expected
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0


def test_passes_do_not_change_leaks(spark, monkeypatch):
    """Stock lines and hyphened words are those of all items, however the items are split."""
    stock = "Read each of the following passages with care and answer what is asked about it in as few words as you possibly can please."
    body = lambda i: " ".join(f"w{(i * 31 + j * (i + 7)) % 997}" for j in range(30)) + f" over-land{i} tail"
    items = spark.createDataFrame([(i, f"{stock}\n{body(i)}\nQuestion: what is {i} {i + 1}\nAnswer: x") for i in range(24)] + [(30, "a plain overland5 word with nothing more")], "item_id long, text string")
    docs = [(i, f"Before. {body(i)} after.") for i in range(24)] + [(100, stock + " " + stock), (101, body(5).replace("-", "")), (102, body(6).replace("over-", "over-\n")), (103, body(7).replace("over-land", "over land"))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    expected = sorted([(i, i) for i in range(24)] + [(101, 5), (102, 6), (103, 7)])
    shared = leakage.shared_by(items)
    assert shared.stock == {stock} and shared.compounds["overland5"] == ("over", "land5")
    for bound in (20_000_000, 2_000, 200):
        monkeypatch.setattr(leakage, "ITEM_CHARS", bound)
        assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == expected


# --- subject areas -----------------------------------------------------------------------------------------------------


def test_areas_on_held_out_examples(spark):
    """Examples that the model has not seen are given their area, alone and mixed."""
    rows = [(r["area"], r["text"]) for r in table(spark, SMALL, "area_examples").orderBy("example_id").collect()]
    held, fitted = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    docs = table(spark, SMALL, "documents").where("length(text) > 0").collect()
    texts, sources = [d["text"] for d in docs], [d["source"] for d in docs]
    model = areas.fit_chain(areas.fit_terms(fitted, texts), fitted, texts, sources)
    got = areas.classify([t for _, t in held], [None] * len(held), model)
    # without a glossary 43 of 48 are right: all in English, fewer where a language keeps no example of the area or one
    assert np.mean([g == [a] for g, (a, _) in zip(got, held)]) >= 0.85
    assert np.mean([g == [a] for g, (a, t) in zip(got, held) if areas.LANGUAGES[int(areas.encode([t]).terms[0]) >> 59] == "en"]) >= 0.97
    english = [(a, t) for a, t in held if t.isascii()]
    mixed = areas.classify([f"{t}\n\n{u}" for (_, t), (_, u) in zip(english, english[1:])], [None] * (len(english) - 1), model)
    n = [[len(areas.sentence_terms(t)) for t in (x[1], y[1])] for x, y in zip(english, english[1:])]
    wanted = [sorted({a for a, k in ((x[0], c[0]), (y[0], c[1])) if 4 * k >= sum(c)} if x[0] != y[0] else {x[0]}) for (x, y), c in zip(zip(english, english[1:]), n)]
    assert np.mean([g == w for g, w in zip(mixed, wanted)]) >= 0.85
    assert areas.classify(["Nothing here is advice. The annex runs to 7 pages.", None, ""], [None] * 3, model) == [[], [], []]
    one = areas.plain_text("<div>One <b>bold</b> word.</div><div>&lt;Two&gt;</div>")
    assert one.split("\n\n")[1:3] != [] and "bold word." in one


def test_area_table(spark):
    docs = table(spark, SMALL, "documents", "doc_id", "text", "source").withColumn("area", F.lit("clash"))
    assert areas.label_documents(docs, table(spark, SMALL, "area_examples").limit(0)).count() == 0
    found = areas.label_documents(docs, table(spark, SMALL, "area_examples")).toPandas()
    assert not found.duplicated().any() and found["doc_id"].nunique() > 0.8 * docs.count() and set(found["area"]) == {r[0] for r in table(spark, SMALL, "subject_areas", "area").collect()}


def test_areas_count_terms_of_all_documents(spark):
    """Terms outside the examples and the chain's sample are learnt; the weights are those of a fit in memory."""
    examples = [("energy", "The turbine feeds the grid. The turbine runs."), ("health", "The nurse saw a patient. The nurse rests.")] * 3
    rng = random.Random(4)
    remark = lambda: " ".join(rng.choice(["brask", "dolin", "vesk", "morat", "pling", "sorev", "tamil", "ubrek", "wend", "yoral"]) + rng.choice("aeiou") for _ in range(5)).capitalize() + "."
    sampled = [f"The turbine by shed {i} failed. A turbine came. The turbine in yard {i} ran." if i % 2 else f"A nurse met patient {i}. The nurse in ward {i} rested." for i in range(16)] + [" ".join(remark() for _ in range(5)) for _ in range(150)]
    texts = sampled + [f"The turbine and quorvane {i} failed. The quorvane near turbine {i} was mended." for i in range(12)] + ["A quorvane. Old quorvane."] * 2
    ids = [r[0] for r in spark.range(len(texts)).orderBy(F.xxhash64("id")).collect()]  # the sample takes the first
    docs = spark.createDataFrame([(i, t, "s") for i, t in zip(ids, texts)], "doc_id bigint, text string, source string")
    labelled = spark.createDataFrame(examples, "area string, text string")
    for parts in (1, 5):
        found = {tuple(r) for r in areas.label_documents(docs.repartition(parts), labelled, sample=len(sampled)).collect()}
        assert {(i, "energy") for i in ids[len(sampled) :]} <= found
    names, chunks, _ = areas._labelled([(r[0], r[1]) for r in labelled.orderBy("area", "text").collect()])
    encoded = areas._encoded(docs).cache()
    spread_out = areas._fit_terms(names, chunks, areas._count_all(encoded), lambda terms: areas._tally(areas._narrowed(encoded, terms), len(names) + 1))
    local = areas.fit_terms(examples, texts)
    assert np.array_equal(spread_out.terms, local.terms) and np.array_equal(spread_out.weights, local.weights)
    assert areas.term_numbers(["quorvane"])[0] in local.terms


def test_chain_decides():
    """The answer is the best combination of the chain, not the count of sentences."""
    k = 2
    read = areas.Reading(np.array([4, 4, 0]), np.array([[4, 0, 0], [1, 1, 2], [0, 0, 0]], float), np.array([[3.9, 0, 0.1], [1, 1, 2], [0, 0, 0]], float), np.full((3, 3), 0.01))
    model = areas.AreaModel(["a", "b"], np.zeros(0, np.int64), np.zeros((0, 3)))
    width = areas._features(read, [None] * 3, model).shape[1]
    no, yes = np.zeros(width), np.zeros(width)
    no[0], yes[0] = -9.0, 9.0
    model.chain, model.calibration = [no, np.append(yes, -20.0)], [(0.0, 1.0)] * k
    assert areas._decided(read, [None] * 3, model).tolist() == [[False, True], [False, True], [False, False]]
    model.chain[0] = yes  # the second link sees the first label and gives way to it
    assert areas._decided(read, [None] * 3, model).tolist() == [[True, False], [True, False], [False, False]]


def test_beam_finds_the_best_combination():
    rng = np.random.default_rng(3)
    model = areas.AreaModel(list("abc"), np.zeros(0, np.int64), np.zeros((0, 4)), [rng.normal(size=4 + j) for j in range(3)], [(0.1, 1.2)] * 3)
    x = rng.normal(size=(50, 4))

    def logp(row, labels):
        total = 0.0
        for j, on in enumerate(labels):
            z = 0.1 + 1.2 * (row @ model.chain[j][:4] + np.array(labels[:j], float) @ model.chain[j][4:])
            total -= np.log1p(np.exp(-z if on else z))
        return total

    best = [max(itertools.product([False, True], repeat=3), key=lambda c: logp(row, c)) for row in x]
    assert [tuple(r) for r in areas.decode(model, x).tolist()] == best


def test_subject_words_keep_to_fewer_documents():
    """A word in every sentence of some documents is topical, one in as many sentences of documents by chance is not."""
    size, docs = 10, 200
    chance = docs * (1 - (1 - 200 / (size * docs)) ** size)
    n, seen = np.array([200, 200, 3]), np.array([20, round(chance), 3])
    assert areas._topical(np.zeros(3, np.int64), n, seen, np.array([size * 16]), np.array([docs]))[0].tolist() == [True, False, False]
    h, m, d = areas.term_counts(areas.encode(["Grid grid turbines. Grid again.", None, "", "Grid."]))
    at = dict(zip(h.tolist(), zip(m.tolist(), d.tolist())))
    assert at[int(areas.term_numbers(["grid"])[0])] == (3, 2) and at[areas.LENGTHS - 32] == (1, 1) and at[areas.LENGTHS - 16] == (1, 1)
