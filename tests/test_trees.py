"""Forests and boosted trees: one row costs one step a column, rows are dealt evenly, models are stored whole."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shelflight.operators import training as tr
from shelflight.operators import trees as te


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.range(6_000).selectExpr(
        "concat('k', id) Batch_No", "concat('c', id % 40) Category", "element_at(array('A', 'B', 'C'), cast(id * 7 % 3 + 1 as int)) ABC_Category",
        "concat('b', id % 7) Brand", "cast(id * 37 % 101 as double) Cost_Price", "cast(id * 53 % 51 as double) Selling_Price",
        "cast(id * 71 % 997 as double) Stock_Quantity", "cast(id % 19 as double) Min_Stock_Level", "cast(id % 23 as double) Max_Stock_Level",
    )
    return df.withColumns({
        "Sales_Velocity": F.expr("Cost_Price * 0.3 + if(Category in ('c3', 'c9'), 20, 0) + if(ABC_Category = 'A', 5, 0)"),
        "Expiry_Risk": F.expr("case when Cost_Price > 70 and Brand = 'b3' then 'High' when Selling_Price > 30 then 'Medium' else 'Low' end"),
    }).cache()


def _best_split(x, y, codes):
    """The split of all rows that lowers the squared error most, one feature and value after another."""
    best = (0.0, None)
    for i, size in enumerate(codes.sizes):
        known = range(size - 1)
        for c in known:
            right = x[i] == c if i < len(codes.categories) else x[i] > c
            if right.any() and not right.all():
                gain = y.var() * len(y) - sum(p.var() * len(p) for p in (y[right], y[~right]))
                best = max(best, (gain, (i, c)), key=lambda b: b[0])
    return best[1]


def test_first_split_is_the_best_of_all_one_hot_features(spark, lines, monkeypatch):
    monkeypatch.setattr(tr, "BOOST_ROUNDS", 3)
    model = tr.fit_demand(lines).stages[0]
    codes, trees = te.unpacked(model.getOrDefault("trees"))
    assert len(trees) == tr.BOOST_ROUNDS and max(map(te._depth, trees)) <= tr.BOOST_DEPTH
    rows = lines.toPandas()
    x = te._coder(codes)([rows[c] for c in (*tr.DEMAND_CATEGORIES, *tr.DEMAND_NUMBERS)])
    assert (trees[0].column[0], trees[0].code[0]) == _best_split(x, rows["Sales_Velocity"].to_numpy(), codes)


def test_models_learn_store_and_answer_alike(spark, lines, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "BOOST_ROUNDS", 20)
    monkeypatch.setattr(tr, "FOREST_TREES", 40)
    learn, ask = lines.filter("hash(Batch_No) % 5 != 0"), lines.filter("hash(Batch_No) % 5 = 0")
    for fit, wanted in ((tr.fit_expiry, "Predicted_Expiry_Risk = Expiry_Risk"), (tr.fit_demand, "abs(Predicted_Sales_Velocity - Sales_Velocity) < 3")):
        model = fit(learn)
        model.write().overwrite().save(str(tmp_path / fit.__name__))
        loaded = PipelineModel.load(str(tmp_path / fit.__name__))
        one, two = (sorted(m.transform(ask).collect(), key=str) for m in (model, loaded))
        assert one == two
        assert model.transform(ask).filter(wanted).count() >= 0.95 * ask.count()
    odd = ask.limit(1).withColumns({"Category": F.lit(None).cast("string"), "ABC_Category": F.lit("never seen")})
    assert odd.transform(lambda d: model.transform(d)).count() == 1


def test_a_forest_depends_on_no_partitioning(spark, lines, monkeypatch):
    monkeypatch.setattr(te, "TREES_AT_ONCE", 2)
    monkeypatch.setattr(te, "BLOCK", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    codes = te.learn_codes(lines, tr.EXPIRY_CATEGORIES, tr.EXPIRY_NUMBERS[:4])

    def grown(df):
        inputs = [F.col(c).cast("string") for c in tr.EXPIRY_CATEGORIES] + [F.col(c) for c in tr.EXPIRY_NUMBERS[:4]]
        label = F.expr("case Expiry_Risk when 'High' then 0 when 'Low' then 1 else 2 end")
        parts = te._parts(df, codes, inputs, label, F.col("Batch_No"), np.int64)
        sizes = parts.map(lambda p: len(p[1])).collect()
        return te.grow_forest(parts, codes, 3, 3, 4, 7), sizes

    (one, few), (two, _) = grown(lines.repartition(1)), grown(lines.repartition(5, "Batch_No"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # One partition of rows is dealt evenly over the cores.
    assert len(few) == 12 and max(few) <= 500
    for a, b in zip(one, two, strict=True):
        for name in ("column", "code", "left", "value"):
            assert np.array_equal(getattr(a, name), getattr(b, name))
