"""What a task holds, and how often a text is taken apart, doesn't grow with the tables."""

from pyspark.sql import functions as F

from feedlake.functions.values import price_number
from feedlake.operators import catalog, lookups
from feedlake.plans import views

PRODUCTS = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_products_are_aggregated_by_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    whole = sorted(views.frame(spark, PRODUCTS, "products").collect())
    monkeypatch.setattr(views, "ROWS_A_TASK", 200)
    dealt = views.frame(spark, PRODUCTS, "products")
    rows = spark.read.parquet(f"{PRODUCTS}/lineitem.parquet").count()
    plan = plan_of(dealt)
    assert f", {rows // 200 + 1})" in plan.split("REPARTITION_BY_NUM")[0][-200:]
    # aggregated behind the shuffle alone: nothing is held of a split before it
    assert "partial_max" not in plan.split("REPARTITION_BY_NUM")[1]
    assert sorted(dealt.collect()) == whole


def test_a_price_text_is_stripped_once_for_each_use(spark):
    rows = spark.createDataFrame(
        [("1,50 EUR", "$2.00", "", 9, 8, 1), ("", None, "0", 9, 8, 1), ("12,34\n", "1,234.56", "2", 9, 8, 1), ("x", "3", None, 9, 8, 1), ("1,5", "12,345", "a", 9, 8, 1)],
        "raw_price string, raw_old_price string, raw_in_stock string, price long, original_price long, in_stock int",
    )
    out = catalog.force_raw_fields(rows)
    # two uses of each of two prices: whether it is positive, and its value
    assert plan_of(out).count("EUR|USD") <= 4
    assert [(r.price, r.original_price, r.in_stock, r.discount_percentage) for r in out.collect()] == [
        (1.5, 2.0, 1, 25), (9.0, 8.0, 0, None), (12.34, 1.0, 2, None), (9.0, 3.0, 1, None), (1.0, 12.0, 0, 92),
    ]
    assert spark.range(1).select(price_number(F.lit("USD 12,34 "))).first()[0] == 12.34


def test_a_name_is_taken_apart_once_whoever_lists_it(spark, monkeypatch):
    names = ("Shoe red", "Shoe blue", None)
    rows = [(f % 5, str(f), names[f % 3], "", 1, "active", "{}") for f in range(60)]
    products = spark.createDataFrame(rows, "feed_id int, external_id string, product_name string, colour string, in_stock int, status string, raw_data string")
    laid = []
    monkeypatch.setattr(lookups, "staged", lambda df: laid.append(df) or df)
    found = lookups.colour_siblings(products, products.select("feed_id", "external_id")).collect()
    assert [df.count() for df in laid if "base" in df.columns] == [len(names)]
    assert len(found) == 80 and {(r.strategy, r.colour) for r in found} == {(2, "red"), (2, "blue")}


def test_group_keys_behind_escapes_are_found(spark):
    texts = [r'{"item_group_id":"a"}', '{"group_id":"","parent_id":"p"}', '{"x":"item_group_id"}', '{"parent_sku":7,"parent_id":"p"}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lookups.group_key(F.col("t"))).collect()]
    assert got == ["item_group_id=a", "parent_id=p", None, "parent_sku=7", None]
