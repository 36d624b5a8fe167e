"""Literal cases of parsers, labels and geometry."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, chat, entity, geometry, nets
from tessera.sources import readers


def one(spark, value, make, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text,want", [("tissue: heart, Subject ID: AB 12; age: 4", "ab 12"), ("donor: unknown", None), ("donor: n/a, patient: 7", None), ("patient id = P9\nx", "p9"), ("", None), (None, None), ("patients: 7", None), ("a;individual_id:  \t ", None)])
def test_patient_id(spark, text, want):
    assert one(spark, text, entity.patient_id) == want


def test_patient_key(spark):
    x = spark.createDataFrame([("GSE1", "ab 12", "GSM9", 3), ("GSE1", None, "GSM9", 3), ("GSE1", None, "", 3), ("", "x", None, 4)], "s string, p string, g string, i long")
    got = [r[0] for r in x.select(entity.patient_key(F.col("s"), F.col("p"), F.col("g"), F.col("i"))).collect()]
    assert got == ["GSE1::ab 12", "__unresolved__::GSM9", "__unresolved__::sample_3", "__unresolved__::sample_4"]


@pytest.mark.parametrize("text,want,n", [("atherosclerosis in breast cancer patients", "cardiovascular", 2), ("adrenal tissue", "renal", 1), ("towards an archive", "infectious", 2), ("nothing", nets.UNLABELED, 0), (None, nets.UNLABELED, 0)])
def test_categories(spark, text, want, n):
    assert one(spark, text, lambda x: nets.first_match(nets.haystack(x), nets.DISEASE_NETS)) == want
    assert one(spark, text, lambda x: F.size(nets.all_matches(nets.haystack(x), nets.DISEASE_NETS))) == n


def test_subtypes(spark):
    sub = lambda t, d: one(spark, t, lambda x: nets.subtype(x, F.lit(d)))
    assert sub("hfref left ventricle", False) == nets.TISSUE_ONLY
    assert sub("hfref left ventricle", True) == "heart_failure"
    assert sub("cardiac dcm", True) == nets.UNRESOLVED  # the padded keyword needs both spaces
    assert sub("aortic", True) == nets.UNRESOLVED
    old = lambda t, d: one(spark, t, lambda x: nets.canonical_subtype(x, F.lit(d)))
    assert (old(nets.LEGACY, True), old(nets.LEGACY, False), old("hypertension", False)) == (nets.UNRESOLVED, nets.TISSUE_ONLY, "hypertension")


@pytest.mark.parametrize("text,want", [("No, it is not. Yes", "no"), ("Nothing here", "yes"), ("it is not", "no"), ("", "yes")])
def test_yes_no(spark, text, want):
    assert one(spark, text, answers.yes_no) == want


@pytest.mark.parametrize("text,want", [("B", "B"), ("B. because", "B"), ("The answer is C.", "C"), ("The answer is C", "FAILED"), ("The answer is A. The answer is B. ", "FAILED"), ("F", "FAILED")])
def test_choice_letter(spark, text, want):
    assert one(spark, text, answers.choice_letter) == want


@pytest.mark.parametrize("text,want", [("The two dogs", "2 dogs"), ("dont", "don't"), ("a..b", "ab"), ("a.1.", "a.1"), ("...", ""), ("x (y) z", "x y z"), ("10,000 men", "10000 men"), ("red-green", "red green"), ("it's", "it 's"), ("\tThe  end\n", "end")])
def test_normalize(spark, text, want):
    assert one(spark, text, answers.normalize) == want


def test_multi_choice(spark):
    o = F.array(*[F.struct(F.lit(k).alias("letter"), F.lit(v).alias("answer")) for k, v in (("A", "red rock"), ("B", "Blue sea"))])
    pick = lambda t: one(spark, t, lambda x: answers.multi_choice(x, o))
    assert pick("(B) then (A).") == "A"
    assert pick("maybe A or B !") == "B"
    assert pick("I would say that it is the blue sea") == "B"
    assert pick("blue sea") == pick("blue sea") in ("A", "B")


def test_gqa(spark):
    assert one(spark, "Yes...", answers.rstrip_stops) == "yes"


def test_rounds_and_prompt(spark):
    def build(turns):
        return spark.createDataFrame([(turns,)], "t array<struct<role:string,text:string>>").select(chat.rounds(F.col("t")).alias("r"))

    got = build([("system", "s"), ("user", "q"), ("assistant", "a")]).first()[0]
    assert [tuple(p) for p in got] == [("q", "a")]
    assert build([("user", "q"), ("assistant", "a"), ("user", "x")]).first()[0] is None
    p = build([("user", "look <image>"), ("assistant", None)]).select(chat.prompt(F.col("r"), chat.template("phi"))).first()[0]
    assert p == chat.SYSTEM + " USER: <image>\nlook ASSISTANT:"
    pre = build([("user", "<image>"), ("assistant", "cap")]).select(chat.prompt(F.col("r"), chat.template("pretrain"))).first()[0]
    assert pre == "<image>cap\n"


def test_padding_keeps_the_original_length(spark):
    x = spark.createDataFrame([([5, 0, 7],)], "i array<int>")
    got = x.select(chat.padded(F.col("i"), F.lit(5), 0), chat.attention(F.col("i"), F.lit(5)), chat.padded(F.col("i"), F.lit(2), 0)).first()
    assert list(got) == [[5, 0, 7, 0, 0], [1, 1, 1, 0, 0], [5, 0]]


def test_geometry(spark):
    x = spark.createDataFrame([(800, 600)], "w int, h int")
    assert tuple(x.select(geometry.best_resolution(F.col("w"), F.col("h"), [(336, 672), (672, 672)])).first()[0]) == (672, 672)
    assert [tuple(t) for t in x.select(geometry.tile_boxes(F.lit(4), F.lit(3), 2)).first()[0]] == [(0, 0, 2, 2), (2, 0, 4, 2), (0, 2, 2, 4), (2, 2, 4, 4)]
    assert tuple(x.select(geometry.fit_and_pad(F.col("w"), F.col("h"), F.lit(400), F.lit(400))).first()[0]) == (400, 300, 0, 50)
    assert tuple(x.select(geometry.square_offsets(F.col("w"), F.col("h"))).first()[0]) == (800, 0, 100)


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, title string")
    assert readers.first_present(df, "x", "title") == "title"
    with pytest.raises(KeyError):
        readers.first_present(df, "x", required=True)
    assert [r[0] for r in readers.in_order(df, "id", [1, 1]).select("pos").collect()] == [0, 1]
    assert readers.resolve(["b.csv", "a.csv"], "*.csv") == "a.csv"
    with pytest.raises(FileNotFoundError):
        readers.resolve([], "*.csv")
    (tmp_path / "x.json").write_text('[{"id": 1, "q": "a"},\n {"id": 2}]')
    assert readers.json_array(spark, str(tmp_path / "x.json"), "id int, q string").count() == 2
