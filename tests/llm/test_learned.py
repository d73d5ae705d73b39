"""Word pieces against plain greedy matching; classifiers by held-out accuracy; the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest
from conftest import SMALL
from llm.conftest import SCHEMA, rows_of
from llm.test_groups import check_mix, fingerprint, linked
from llm.test_scans import contaminated

import corpus_pipeline
from serupa.llm import language_net, pii_field, stages, toxicity, wordpiece_counts
from serupa.llm.queries import QUERIES
from serupa.llm.sampling import bounded_sample

MEDIUM = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def greedy(word, pieces):
    text, n = b" " + word, 0
    while text:
        size = next((k for k in range(len(text), 0, -1) if text[:k] in pieces), 1)
        text, n = text[size:], n + 1
    return n


def test_word_pieces_small_vocabulary():
    r = random.Random(4)
    for _ in range(60):
        pieces = {bytes(r.choice(b"ab ") if j == 0 else r.choice(b"ab") for j in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))}
        automaton = wordpiece_counts.Automaton(sorted(pieces))
        for _ in range(40):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_word_pieces(docs, odd_texts):
    pieces = set(wordpiece_counts.read_vocabulary())
    texts = [t and t[:2000] for t in odd_texts] + [r"antidisestablishmentarianism é漢字 don't 12345678 \\"]
    for r in wordpiece_counts.token_counts(docs(texts, repeat=[14]), ["doc_id"]).collect():
        w = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(w), sum(greedy(x, pieces) for x in w))
    assert wordpiece_counts.token_counts(docs(["a"]).where("false"), ["doc_id"]).count() == 0


def test_word_pieces_of_documents(spark):
    pieces = set(wordpiece_counts.read_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_wordpiece_counts"](spark, SMALL).collect():
        assert r.n_tokens == sum(greedy(x, pieces) for x in texts[r.doc_id].encode().split())


def test_bounded_sample(spark):
    df = spark.range(20_000)
    assert bounded_sample(df, 30_000, "id").count() == 20_000
    assert 700 < bounded_sample(df, 1000, "id").count() < 1300
    assert bounded_sample(df.selectExpr("1 AS id"), 1000, "id").count() <= 2000


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = QUERIES["op6_language_net"](spark, MEDIUM).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.97


def test_language_of_odd_texts(spark, docs, odd_texts):
    known = docs(["the and of to in is was", "the it for with on are be"] * 30, first=100)
    net = language_net.fit_network(known)
    rows = {r.doc_id: r for r in language_net.predict(docs(odd_texts, repeat=[5]), net, ["doc_id"]).collect()}
    letters = [any(c.isalpha() for c in t or "") for t in odd_texts]
    assert [rows[i].lang_pred for i in range(len(odd_texts))] == ["en" if x else "und" for x in letters]
    none = language_net.fit_network(known.where("false"))
    assert none is None and {(r.lang_pred, r.score) for r in language_net.predict(docs(odd_texts), none, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language_net.predict(docs(["a"]).where("false"), net, ["doc_id"]).count() == 0


def test_language_network_reads_as_it_was_trained():
    net = language_net.Network.fresh(["a", "b", "c"], 1)
    codes = np.random.default_rng(0).integers(0, 256, (70, language_net.WINDOW)).astype(np.uint8)
    x = net.embedding[language_net._padded(codes)]
    best = np.max([x[:, i : i + language_net.LONGEST].reshape(70, -1) @ net.filters for i in range(language_net.WINDOW)], axis=0)
    assert np.allclose(language_net.Reader(net).shares(codes), net.softmax(best), atol=1e-4)
    gradients = language_net._gradients(net, codes[:8], np.arange(8) % 3, np.ones(8, np.float32))

    def loss():
        x = net.embedding[language_net._padded(codes[:8])]
        best = np.max([x[:, i : i + language_net.LONGEST].reshape(8, -1) @ net.filters for i in range(language_net.WINDOW)], axis=0)
        return -np.log(net.softmax(best)[np.arange(8), np.arange(8) % 3]).mean()

    for p, g in zip(net.parameters(), gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[at]
        p[at] = keep + 2e-3
        up = loss()
        p[at] = keep - 2e-3
        down = loss()
        p[at] = keep
        assert abs((up - down) / 4e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, folder).collect()
    test = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) for r in rows)
    score, truth = np.array([r.score for r in test]), np.array([toxic[r.doc_id] for r in test])
    assert np.mean([(a > b) + (a == b) / 2 for a in score[truth == 1] for b in score[truth == 0]]) > 0.97
    assert np.mean((score >= 0.5) == truth) > 0.95


def test_toxicity_of_odd_tables(spark, docs, odd_texts):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(100, 160)] + [(100, 1, 1), (None, 1, 1), (101, None, 1)], "doc_id long, toxic int, quality int")
    table = docs([f"you awful fool {i}" if i % 2 else f"a fine day {i}" for i in range(60)], first=100)
    model = toxicity.fit_model(table, labels)
    rows = toxicity.score(docs([*odd_texts, "awful fool", "fine day"]), model, ["doc_id"]).collect()
    assert all(0 <= r.score <= 1 for r in rows) and [r.predicted for r in rows[-2:]] == [1, 0]
    nothing = toxicity.fit_model(table, labels.where("false"))
    assert {r.predicted for r in toxicity.score(table, nothing, ["doc_id"]).collect()} == {0}
    only = toxicity.fit_model(table, labels.where("toxic = 1"))
    assert {r.predicted for r in toxicity.score(table, only, ["doc_id"]).collect()} == {1}


def test_toxicity_prior_does_not_depend_on_the_sample(spark, docs, monkeypatch):
    """Texts that tell nothing get the share of toxic of all labelled rows, though a third of the drawn is toxic."""
    ids = [i for i in range(1000) if not held(i)][:700]
    labels = spark.createDataFrame([(i, int(n % 10 == 0)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    table = docs(["the same words for all"] * 1000)
    monkeypatch.setattr(toxicity, "FETCHES", 1)
    model = toxicity.fit_model(table, labels, fit_docs=90)
    assert 0.07 < model.score(toxicity.Features()(b"the same words for all")) < 0.14


def test_features_do_not_depend_on_pieces(monkeypatch):
    features, r = toxicity.Features(), random.Random(1)
    text = bytes(r.randrange(256) for _ in range(3000)).lower()
    whole = features(text)
    assert len(set(whole.tolist())) == len(whole) and np.array_equal(whole, features(text)) and len(features(b"a")) == 0
    monkeypatch.setattr(toxicity, "PIECE", 100)
    features(b"another text in between")
    assert set(features(text).tolist()) == set(whole.tolist())


@pytest.fixture(scope="module")
def staged(spark):
    """Each stage's input and output over small documents with odd rows and an extra column."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, "1234 !!", "en", "src0", 7), (None, "some text without an id here", "en", None, 28), rows[3], rows[3], (1003, rows[7][1], "en", "src1", rows[7][4])]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    out = [docs]
    for _, apply in corpus_pipeline.STAGES:
        made = apply(spark, out[-1], SMALL)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_stages_keep_columns(staged):
    assert all(x.columns == staged[0].columns and x.dtypes == staged[0].dtypes for x in staged[1:-1])
    assert staged[-1].columns == ["doc_id", "size", "source_size", "target", "taken", "text", "lang", "source"]


def test_stages_pass_columns_of_any_type(spark):
    """Maps, variants, arrays and structs, with repeated rows, null texts throughout and no labels."""
    made = "map('k', id) AS m, parse_json('[1, 2]') AS v, array(id) AS a, named_struct('x', id) AS s"
    texts = "CASE WHEN id < 3 THEN 'one and the same text here' WHEN id < 6 THEN concat('another text of number ', id * 1000003) END"
    docs = spark.sql(f"SELECT id AS doc_id, {texts} AS text, CAST(null AS string) AS lang, 'src' AS source, 0L AS n_chars, {made} FROM range(8)")
    docs = docs.unionByName(docs.where("doc_id = 1"))
    kept = stages.keep_recognised_languages(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1, 1, 2, 3, 4, 5]  # no labels: all with a letter
    for apply in (stages.keep_one_of_near_copies, stages.drop_contaminated, stages.mask_personal_data):
        assert apply(spark, docs, SMALL).columns == docs.columns
    once = [r.doc_id for r in stages.keep_one_of_near_copies(spark, docs, SMALL).select("doc_id").collect()]
    assert 0 in once and 1 not in once and 2 not in once and len(once) == len(set(once)) and once.count(6) + once.count(7) == 1
    assert stages.mix_sources(spark, docs, SMALL).count() == 9


def test_stage_language(staged):
    gone = set(staged[0].collect()) - set(staged[1].collect())
    assert {r.doc_id for r in gone} == {1000, 1001, 1002} and staged[1].count() == staged[0].count() - 3


def test_stage_language_rejects_what_is_in_no_learned_language(spark):
    """With one learned language as with four."""
    rows = [r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").orderBy("doc_id").collect() if len(r.text) < 2000]
    r = random.Random(3)
    planted = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "人人生而自由在尊严和权利上一律平等", "12 34 !! x 56"]
    planted += [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(40))]
    for langs in (["en"], ["de", "en", "es", "fr"]):
        known = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in rows if x.lang in langs]
        docs = spark.createDataFrame(known + [(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
        kept = {x.doc_id for x in stages.keep_recognised_languages(spark, docs, MEDIUM).select("doc_id").collect()}
        assert not [i for i in kept if i >= 10**6]
        assert len({x[0] for x in known} - kept) <= len(known) / 500


def test_stage_near_copies(staged):
    rows = staged[1].collect()
    roots = linked([fingerprint(r.text) for r in rows])
    best = {}
    for r, root in zip(rows, roots, strict=True):
        best.setdefault(root, []).append((r.doc_id is None, r.doc_id or 0))
    want = sorted(min(v) for v in best.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in staged[2].collect()) == want


def test_stage_contamination(spark, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    keep = [r for r in staged[2].collect() if not ((h := contaminated(r.text, items))[1] > 0 and 20 * h[1] >= h[0])]
    assert sorted(map(repr, keep)) == sorted(map(repr, staged[3].collect()))


def test_stage_personal_data(staged):
    before, after = {r.doc_id: r for r in staged[3].collect()}, {r.doc_id: r for r in staged[4].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert not pii_field.base_spans(after[i].text) and after[i].n_chars == len(after[i].text)
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert after[i].text == r.text
    assert any(before[i].text != after[i].text for i in before)


def test_stage_mix(staged):
    rows = staged[4].collect()
    ids = {r.doc_id: n for n, r in enumerate(rows)}
    assert sorted((r.text or "") for r in staged[5].collect()) == sorted((r.text or "") for r in rows)
    got = [r.asDict() | {"doc_id": ids[r.doc_id]} for r in staged[5].collect()]
    check_mix([type("R", (), x | {"__getitem__": lambda self, k: getattr(self, k)})() for x in got], [(r.source, r.text) for r in rows], 0.03)


def test_pipeline_query(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame(rows_of([]), SCHEMA)
    for apply in (stages.keep_recognised_languages, stages.keep_one_of_near_copies, stages.drop_contaminated, stages.mask_personal_data, stages.mix_sources):
        assert apply(spark, empty, SMALL).count() == 0
