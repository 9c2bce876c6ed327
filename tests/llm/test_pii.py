import os
import sys

import pytest
from pyspark.sql import functions as F

from stylograph.llm import pii
from stylograph.llm.pii_examples import FAMILY, GIVEN, labelled_table

sys.path.insert(0, os.path.dirname(__file__))
from pii_cases import CASES  # noqa: E402

NAMES = [("Peroan", "given"), ("Dervane", "given"), ("Haleth", "given"), ("Vesiska", "given"), ("TAMISKA", "given"), ("Falcombe", "family"), ("Munquist", "family"), ("Ashmere ", "family"), ("Kestholt", "family"), ("Rose", "given"), (None, None)]


@pytest.fixture(scope="module")
def field():
    return pii.fitted(sorted((t, k or "") for t, k in NAMES if t))


def test_held_out_table(field):
    given, family = [t for t, k in NAMES if k == "given"], [t.strip() for t, k in NAMES if k == "family"]
    table = labelled_table(given, family, 400, seed=77)
    found = field.spans([t for t, _ in table])
    want = {(i, *s) for i, (_, spans) in enumerate(table) for s in spans}
    got = {(i, *s) for i, spans in enumerate(found) for s in spans}
    assert len(want & got) >= 0.88 * len(want) and len(want & got) >= 0.93 * len(got)


@pytest.mark.parametrize("names", [[], sorted((t, k or "") for t, k in NAMES if t)])
def test_texts_written_by_hand(names):
    """Contexts and names that are none of the labelled table's."""
    found = pii.fitted(names).spans([t for t, _ in CASES])
    want = {(i, k, p) for i, (_, pieces) in enumerate(CASES) for k, p in pieces}
    got = {(i, k, CASES[i][0][a:b]) for i, spans in enumerate(found) for a, b, k in spans}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got), (want - got, got - want)
    for kind in pii.KINDS:
        of_kind = {w for w in want if w[1] == kind}
        assert len(of_kind & got) >= 0.85 * len(of_kind), (kind, of_kind - got)
    known = {*GIVEN, *FAMILY}
    assert not [p for _, k, p in want if k == "name" and set(p.title().replace("-", " ").split()) & known]


def test_the_stored_field_is_read_as_it_was_kept(tmp_path):
    field = pii.load()
    path = str(tmp_path / "w.npz")
    pii.store(field, path)
    texts = [t for t, _ in CASES]
    assert pii.load(path).spans(texts) == field.spans(texts)


def test_training_learns():
    """A field fitted to a small table in a few rounds already finds most of what is in it."""
    field = pii.train(rounds=25, rows=300)
    assert sum(map(bool, field.spans([t for t, s in labelled_table(GIVEN, FAMILY, 200, 9) if s]))) >= 60


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("write to <p.falcombe+tea@mail.example.org>!", "email", "p.falcombe+tea@mail.example.org"), ("reach me at haleth_ashmere12 [at] post dot example please", "email", "haleth_ashmere12 [at] post dot example"),
        ("call +44 7700 900 123 after six", "phone", "+44 7700 900 123"), ("WhatsApp (555) 555-0123 if you want in", "phone", "(555) 555-0123"), ("my social is 912-34-5678", "id_number", "912-34-5678"),
        ("party at 128 rue des Tilleuls from eight", "address", "128 rue des Tilleuls"), ("we moved to P.O. Box 417.", "address", "P.O. Box 417"), ("lunch with Haleth Falcombe was fun", "name", "Haleth Falcombe"), ("thanks to Dr. Kestholt, Vesiska for the help", "name", "Kestholt, Vesiska"),
    ],
)
def test_pieces(field, text, kind, piece):
    assert (kind, piece) in {(k, text[a:b]) for a, b, k in field.spans([text])[0]}


@pytest.mark.parametrize("text", ["", "   ", "The kettle is warm and the garden is quiet.", "see https://go.example.test/ab12 @garden77 #x12", "order 123-456789 shipped", "on 2024-12-17 we painted it"])
def test_nothing(field, text):
    assert field.spans([text, None]) == [[], []]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    k, allowed = len(pii.LABELS), pii._allowed()
    e = rng.normal(size=(3, 4, k)).astype(np.float32) * 3
    lengths = np.array([4, 2, 1])
    paths = pii.viterbi(e, allowed, lengths)
    for n in range(3):
        best = max(
            (p for p in itertools.product(range(k), repeat=int(lengths[n])) if not pii.LABELS[p[0]].startswith("I")), key=lambda p: sum(e[n, t, x] for t, x in enumerate(p)) + sum(allowed[a, b] for a, b in zip(p, p[1:]))
        )
        assert tuple(paths[n, : lengths[n]]) == best


def test_columns(spark):
    names = spark.createDataFrame(NAMES, "token string, kind string")
    r = pii.Recognizer(spark, names)
    text = "lunch with Haleth Falcombe was fun. lunch with Haleth Falcombe was fun. call +44 7700 900 123 after six"
    long = "The garden is quiet. " * 20_000 + text
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, long), (1, text)], "id bigint, text string").withColumns({"found": F.lit(1), "kind": F.lit(2), "tbl": F.lit(3), "rec_id": F.lit(4)})
    got = sorted({tuple(x) for x in pii.found(df, r, "t", "id").collect()})
    assert got == [("t", i, k, f) for i in (1, 4) for k, f in (("name", "Haleth Falcombe"), ("phone", "+44 7700 900 123"))]
    out = {x.id: x.y for x in df.select("id", r.redacted("text").alias("y")).collect()}
    assert out[1] == "lunch with [NAME] was fun. lunch with [NAME] was fun. call [PHONE] after six" and out[2] is None and out[3] == ""
    assert pii.found(df.limit(0), r, "t", "id").count() == 0


def test_a_table_of_too_many_names_is_an_error(spark, monkeypatch):
    names = spark.createDataFrame([(f"Name{i}", "given") for i in range(4)] + [(None, "given")], "token string, kind string")
    monkeypatch.setattr(pii, "MOST_NAMES", 3)
    monkeypatch.setattr(pii, "fitted", lambda names: pytest.fail("the names were cut"))
    with pytest.raises(ValueError, match="more than 3 rows"):
        pii.Recognizer(spark, names)
