"""Readers and writers: round trips and malformed input."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ngram
from cadenza.plans import config
from cadenza.sources import readers as R
from cadenza.sources import sinks as W
from tests.conftest import rows


def test_audio(spark, tmp_path):
    x = np.array([0, 1, -2, 32767, -32768], np.int16)
    (tmp_path / "a.wav").write_bytes(W.wav_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxxnope")
    got = rows(R.read_audio(spark, f"{tmp_path}/*.wav").select("rate", "seq", "x"), "seq")
    assert got == [(8000, i, float(v)) for i, v in enumerate(x)]
    assert R.read_audio_errors(spark, f"{tmp_path}/*.wav").count() == 1
    assert R.parse_raw(x.astype(">i2").tobytes()).tolist() == x.tolist()


def test_parameter_files(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(4, 3)
    data = W.parameter_bytes(v, 100_000, 6)
    assert np.array_equal(R.parse_parameters(data)[2], v)
    little = struct.pack("<IIhH", 4, 100_000, 12, 6) + v.astype("<f4").tobytes()
    assert np.array_equal(R.parse_parameters(little)[2], v)
    (tmp_path / "a.mfc").write_bytes(data)
    assert R.read_parameters(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError):
        R.parse_parameters(b"\xff" * 40)


def test_vector_stream():
    a, b = np.ones((2, 3), np.float32), np.zeros((1, 3), np.float32)
    head, got = R.parse_vector_stream(W.vector_stream_bytes([a, b], 10, True))
    assert head == {"length": 3, "shift": 10, "is_outprob": True}
    assert [(s, t) for s, t, _ in got] == [(0, 0), (0, 1), (1, 0)]


def test_cmn_and_npy():
    import io

    assert R.read_cmn(W.cmn_text([1.0, 2.0], [3.0, 4.0])) == {"mean": [1.0, 2.0], "variance": [3.0, 4.0]}
    f = io.BytesIO()
    np.save(f, np.ones((2, 2), "<f4"))
    assert R.read_npy(f.getvalue()).shape == (2, 2)


def test_spectrum():
    assert R.read_spectrum(struct.pack(">i2f", 2, 1.5, 2.5)).tolist() == [1.5, 2.5]


def test_arpa_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "id int, text string")
    t = ngram.estimate(ngram.sentence_words(docs, "id", "text"), "id", 2)
    W.write_arpa(t, f"{tmp_path}/lm")
    back = R.read_arpa(spark, f"{tmp_path}/lm")
    for a, b in zip(t, back):
        words = [c for c in a.columns if c.startswith("w")]
        x = rows(a.select(*words, F.round("logp", 5)))
        y = rows(b.select(*words, F.round("logp", 5)))
        assert x == y


def test_arpa_in_parts_and_splits(spark, tmp_path):
    import glob
    import shutil

    docs = spark.createDataFrame([(i, " ".join("abcdefghij"[(i * j) % 10] * (1 + j % 3) for j in range(1, 9))) for i in range(50)], "id int, text string")
    t = ngram.estimate(ngram.sentence_words(docs, "id", "text"), "id", 2)
    want = [rows(x.select(*[c for c in x.columns if c.startswith("w")], F.round("logp", 5))) for x in t]
    W.write_arpa(t, f"{tmp_path}/lm", 5)
    parts = sorted(glob.glob(f"{tmp_path}/lm/part-*"))
    assert len(parts) > 1
    with open(f"{tmp_path}/one.arpa", "wb") as f:  # the parts are the file; text before its beginning is no entry
        f.write(b"-1.0 a comment\n")
        for p in parts:
            with open(p, "rb") as part:
                shutil.copyfileobj(part, f)
    shutil.copytree(f"{tmp_path}/lm", f"{tmp_path}/two/lm")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(f"{tmp_path}/one.arpa").rdd.getNumPartitions() > 3
        for path in (f"{tmp_path}/lm", f"{tmp_path}/one.arpa"):
            back = R.read_arpa(spark, path)
            assert [rows(x.select(*[c for c in x.columns if c.startswith("w")], F.round("logp", 5))) for x in back] == want
            # entries come line by line: no row holds a whole file
            assert "wholetext" not in back[0]._jdf.queryExecution().toString().lower()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_backoff_cases(spark):
    uni = spark.createDataFrame([("a", -1.0, -0.5), ("b", -0.5, None), ("<unk>", -2.0, None)], "w1 string, logp double, bow double")
    bi = spark.createDataFrame([("a", "b", -0.1)], "w1 string, w2 string, logp double")
    q = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "a"), ("x", "b"), ("a", "<unk>")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.logp for r in ngram.backoff(q, [uni, bi], 2, unknown_words=100).collect()}
    assert got == {("a", "b"): -0.1, ("a", "a"): -1.5, ("b", "a"): -1.0, ("x", "b"): -0.5, ("a", "<unk>"): -4.5}
    assert ngram.backoff(q, [uni, bi], 3).first().logp == -1e6
    assert ngram.generate(lambda c, w: 1.0, ["a", "</s>"], 5) == ngram.generate(lambda c, w: 1.0, ["a", "</s>"], 5)


def test_dictionary_lines(spark):
    lines = spark.createDataFrame([("word @-1.5 [Out] :2 w er d",), ("silent {} s",), ("plain p l",), ("",)], "value string")
    got = {r.wname: r for r in R.parse_dictionary(lines).collect()}
    assert (got["word"].woutput, got["word"].phones, got["word"].cprob, got["word"].weight, got["word"].transparent) == ("Out", ["w", "er", "d"], -1.5, 2.0, False)
    assert got["silent"].transparent and got["silent"].woutput == "" and got["plain"].woutput == "plain"
    assert R.parse_word_list(lines.limit(1)).first().phones == ["silB", "w", "er", "d", "silE"]
    arcs, states = R.parse_dfa_lines(spark.createDataFrame([("0 0 0 0",), ("0 1 1 0",), ("1 -1 -1 1",)], "value string"))
    assert rows(arcs) == [(0, 0, 0), (0, 1, 1)] and rows(states) == [(0, False), (1, True)]


def test_hmm_definitions():
    text = '''~o <VecSize> 2 ~t "T" <TransP> 3 0 1 0 0 .5 .5 0 0 0
    ~s "S" <NumMixes> 2 <Mixture> 1 .4 <Mean> 2 0 0 <Variance> 2 1 1 <Mixture> 2 .6 <Mean> 2 1 1 <Variance> 2 2 2 <GConst> 3.5
    ~h "m" <BeginHMM> <NumStates> 3 <State> 2 ~s "S" ~t "T" <EndHMM>'''
    t = R.parse_hmm_definitions(text)
    assert t["models"] == [("m", 2, 0)] and len(t["gauss"]) == 2 and t["gauss"][1][3] == 3.5 and len(t["trans"]) == 3


def test_outputs(spark):
    n = spark.createDataFrame([(1, 1, -2.5, ["a<", "b"], ["x", "y"], [0.5, 1.0])], "stream int, rank int, score double, words array<string>, phones array<string>, cms array<double>")
    assert W.nbest_lines(n).where("k = 0").first().line == "sentence1: a< b"
    xml = W.recognition_xml(n, ("word", "cm")).first().xml
    assert 'WORD="a&lt;"' in xml and "PHONE" not in xml and xml.startswith("<RECOGOUT>")
    s = spark.createDataFrame([(1, "too_short"), (2, "failed"), (3, "accepted")], "stream int, status string")
    assert [r.xml for r in W.status_xml(s).orderBy("stream").collect()] == ['<REJECTED REASON="too_short"/>', "<RECOGFAIL/>", '<INPUT STATUS="accepted"/>']


def test_sample_source(spark):
    df = R.open_source(spark, "sample_blocks", samples=100, block=30)
    assert df.count() == 200 and df.rdd.getNumPartitions() == 8


def test_config():
    c = config.from_text("-b 500 # beam\n-C more\n-n 3\n-x y z\n", read=lambda n: "-fshift ${S}\n", env={"S": "80"})
    assert (c.search.beam, c.search.sentences, c.features.shift, c.other) == (500, 3, 80, {"x": "y z"})
    with pytest.raises(ValueError):
        config.from_text("-n 1000\n")
    assert len(config.shared_features({"a": config.Config(), "b": config.Config()})) == 1
