import pytest

from tallywarden.operators import validate
from tallywarden.plans.scoring import features_with_policy, score_messages
from tallywarden.plans.catalog import fixed_forest
from tallywarden.schemas import AMOUNT, COUNT, FEATURES, MEAN, SINCE

T = "2025-01-24T10:30:00"
CASES = [
    ('{"user_id":"u","amount":1.5,"timestamp":"%s","x":{"y":1}}' % T, None, "u", 1.5),
    ('{"user_id":null,"amount":true,"timestamp":"20250124"}', None, "None", 1.0),
    ('{"user_id":12,"amount":"1_000","timestamp":20250124}', None, "12", 1000.0),
    ('{"user_id":true,"amount":" 7 ","timestamp":"%s"}' % T, None, "True", 7.0),
    ('{"user_id":"true","amount":1,"timestamp":"%s"}' % T, None, "true", 1.0),
    ('{"amount":1,"timestamp":"x"}', "missing_user_id", None, 1.0),
    ('{"user_id":"u","timestamp":"x"}', "missing_amount", "u", None),
    ('{"user_id":"u","amount":1}', "missing_timestamp", "u", 1.0),
    ('{"user_id":"u","amount":null,"timestamp":"%s"}' % T, "bad_amount", "u", None),
    ('{"user_id":"u","amount":"12d","timestamp":"%s"}' % T, "bad_amount", "u", None),
    ('{"user_id":"u","amount":"true","timestamp":"%s"}' % T, "bad_amount", "u", None),
    ('{"user_id":"u","amount":"nan","timestamp":"%s"}' % T, "bad_amount", "u", None),
    ('{"user_id":"u","amount":2,"timestamp":null}', "bad_timestamp", "u", 2.0),
    ('{"user_id":"u","amount":2,"timestamp":"yesterday"}', "bad_timestamp", "u", 2.0),
    ("not json", "bad_json", None, None),
    ("[1]", "missing_user_id", None, None),
    (None, "bad_json", None, None),
]


@pytest.fixture
def decoded(spark):
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "seq bigint, value string")
    return validate.decode_events(raw)


def test_reasons_and_coercions(decoded):
    got = [(r.reject_reason, r.user_id, r.amount) for r in decoded.orderBy("seq").collect()]
    assert got == [c[1:] for c in CASES]
    assert decoded.where("seq = 0").first().event == CASES[0][0]


def test_filter_does_not_parse_twice(decoded):
    plan = validate.valid_rows(decoded)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") == 1 or plan.count("parseJson") <= 1


def test_policy(decoded):
    skipped = features_with_policy(decoded, fill_missing=False)
    filled = features_with_policy(decoded, fill_missing=True)
    assert skipped.count() == 5 and filled.count() == len(CASES)
    rows = {r.seq: r for r in filled.collect()}
    assert (rows[12][AMOUNT], rows[12][MEAN], rows[12][COUNT], rows[12][SINCE]) == (2.0, 0.0, 0, 0.0)
    assert rows[9][AMOUNT] == 0.0
    # Rejected rows of user "u" leave its running values alone.
    assert rows[0][MEAN] == 1.5 and rows[0][COUNT] == 1
    scored = score_messages(decoded, fixed_forest(), 0.6, fill_missing=True)
    assert scored.count() == len(CASES) and scored.where("anomaly_score is null").count() == 0
    assert scored.select("transaction_id").distinct().count() == len(CASES) and scored.where("transaction_id is null").count() == 0


@pytest.fixture
def dirty(spark):
    rows = [("1", "2", "3", "4"), ("x", "2", "3", "4"), ("1", None, "3", "4"), ("1", "2", "NaN", "4"), ("1", "2", "3", None)]
    return spark.createDataFrame(rows, FEATURES)


def test_cleaning(dirty):
    rows = [tuple(r) for r in validate.clean_training(dirty).collect()]
    assert rows == [(1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, 0.0)]
    assert tuple(validate.cleaning_report(dirty).first()) == (5, 2, 3)
    with pytest.raises(KeyError):
        validate.clean_training(dirty.drop(SINCE))


def test_counts(dirty):
    bad = {r.column_name: r.bad_rows for r in validate.count_not_numeric(dirty, FEATURES).collect()}
    nulls = {r.column_name: (r.rows, r.nulls) for r in validate.null_counts(dirty).collect()}
    assert bad == {c: 1 for c in FEATURES}
    assert nulls == {AMOUNT: (5, 0), MEAN: (5, 1), COUNT: (5, 0), SINCE: (5, 1)}
    with pytest.raises(ValueError, match=AMOUNT):
        validate.assert_numeric(dirty)
    assert validate.assert_numeric(dirty.limit(1)).dtypes == [(c, "double") for c in FEATURES]


def test_vectors(dirty, spark):
    rows = validate.vector(dirty, FEATURES).collect()
    assert rows[0].vector == [1.0, 2.0, 3.0, 4.0] and [r.vector for r in rows[1:]] == [None] * 4
    with pytest.raises(KeyError, match="nope"):
        validate.vector(dirty, [AMOUNT, "nope"])
    maps = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"x": 1.0},), ({"a": 1.0, "b": None},)], "m map<string,double>")
    got = validate.vector_from_map(maps, "m", ["b", "a"]).collect()
    assert [(r.vector, r.missing_features) for r in got] == [([2.0, 1.0], []), (None, ["b", "a"]), (None, [])]


def test_select_features(spark):
    names = [f"V{i}" for i in range(1, 29)] + ["Amount", "Class"]
    wide = spark.createDataFrame([tuple(float(i) for i in range(30))], names)
    assert validate.select_features(wide).columns == names[:-1]
    with pytest.raises(KeyError, match="V3"):
        validate.select_features(wide.drop("V3"))
