"""Everyday grouping, unwinding and lookup patterns over the test tables."""

from __future__ import annotations


from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from xrel.plans.registry import register
from xrel.session import cut_lineage
from xrel.sources import tpch

_MONEY = "decimal(18,2)"


def _money(c: str) -> Column:
    return F.col(c).cast(_MONEY)


def _sum(c: str | Column) -> Column:
    """Exact sum of amounts with two decimals, whatever the order of the rows."""
    return F.sum(_money(c) if isinstance(c, str) else c).cast("double")


def _mean(total: Column, n: Column) -> Column:
    return F.round(total.cast("double") / n, 6)


_SUM = "sum({}::decimal(18,2))::double"


@register(
    "group_basic",
    f"select l_returnflag as flag, l_linestatus as status, count(*) as n, {_SUM.format('l_extendedprice')} as total, "
    f"round({_SUM.format('l_extendedprice')} / count(*), 6) as average, min(l_extendedprice) as lowest, max(l_extendedprice) as highest from lineitem group by all "
    f"union all select l_returnflag, null, count(*), {_SUM.format('l_extendedprice')}, round({_SUM.format('l_extendedprice')} / count(*), 6), min(l_extendedprice), max(l_extendedprice) from lineitem group by all "
    f"union all select null, null, count(*), {_SUM.format('l_extendedprice')}, round({_SUM.format('l_extendedprice')} / count(*), 6), min(l_extendedprice), max(l_extendedprice) from lineitem",
)
def group_basic(spark, sf_dir):
    """By two keys, by one and by none, in one pass."""
    price = "l_extendedprice"
    return (
        tpch.table(spark, sf_dir, "lineitem")
        .rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
        .agg(
            F.count("*").alias("n"), _sum(price).alias("total"), _mean(F.sum(_money(price)), F.count("*")).alias("average"),
            F.min(price).alias("lowest"), F.max(price).alias("highest"),
        )
    )


@register(
    "array_accumulators",
    "select l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as pushed, "
    "string_agg(distinct l_returnflag, ',' order by l_returnflag) as added, "
    "arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) as first_part, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) as last_part, "
    "arg_max(l_partkey, (l_extendedprice, l_partkey)) as top_part from lineitem group by 1",
)
def array_accumulators(spark, sf_dir):
    """Per order: lines pushed in order of shipment, distinct flags, the first and last part by that order, the dearest.

    A pushed list is as long as its order has lines; that is the accumulator's feature.
    """
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    shown = F.concat_ws(":", "l_linenumber", "l_partkey")
    pushed = F.sort_array(F.collect_list(F.struct(order.alias("o"), shown.alias("t"))))
    return tpch.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(pushed["t"], ",").alias("pushed"),
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("added"),
        F.min_by("l_partkey", order).alias("first_part"),
        F.max_by("l_partkey", order).alias("last_part"),
        F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("top_part"),
    )


@register(
    "conditional_agg",
    "select p_brand, count_if(p_retailprice > 1000)::bigint as dear, "
    f"coalesce({_SUM.format('case when p_retailprice > 1000 then p_retailprice end')}, 0) as dear_total, "
    "coalesce(string_agg(distinct case when p_size > 40 then p_type end, ',' order by case when p_size > 40 then p_type end), '') as big_types from part group by 1",
)
def conditional_agg(spark, sf_dir):
    dear = F.col("p_retailprice") > 1000
    return tpch.table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(dear).alias("dear"),
        F.coalesce(_sum(F.when(dear, _money("p_retailprice"))), F.lit(0.0)).alias("dear_total"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type")))), ",").alias("big_types"),
    )


@register(
    "date_group",
    f"select year(o_orderdate)::int as year, month(o_orderdate)::int as month, {_SUM.format('o_totalprice')} as revenue, count(*) as orders, "
    f"round({_SUM.format('o_totalprice')} / count(*), 6) as average from orders group by 1, 2",
)
def date_group(spark, sf_dir):
    return tpch.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        _sum("o_totalprice").alias("revenue"), F.count("*").alias("orders"),
        _mean(F.sum(_money("o_totalprice")), F.count("*")).alias("average"),
    )


@register(
    "expression_group",
    "select case when l_extendedprice < 20000 then 'small' when l_extendedprice < 65000 then 'usual' when l_extendedprice >= 65000 then 'large' else 'none' end as band, "
    f"count(*) as n, round({_SUM.format('l_extendedprice')} / count(*), 6) as average from lineitem group by 1",
)
def expression_group(spark, sf_dir):
    price = F.col("l_extendedprice")
    band = F.when(price < 20000, "small").when(price < 65000, "usual").when(price >= 65000, "large").otherwise("none")
    return tpch.table(spark, sf_dir, "lineitem").groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), _mean(F.sum(_money("l_extendedprice")), F.count("*")).alias("average")
    )


@register(
    "unwind_group",
    f"select word, count(*) as n, {_SUM.format('p_retailprice')} as total, string_agg(distinct p_type, ',' order by p_type) as types "
    "from (select p_retailprice, p_type, unnest(string_split(p_name, ' ')) as word from part) group by 1",
)
def unwind_group(spark, sf_dir):
    words = tpch.table(spark, sf_dir, "part").select("p_retailprice", "p_type", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(
        F.count("*").alias("n"), _sum("p_retailprice").alias("total"),
        F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"),
    )


@register(
    "top_n_per_group",
    "select p_brand, place, l_partkey, sales from (select *, row_number() over (partition by p_brand order by sales desc, l_partkey) as place from "
    f"(select p_brand, l_partkey, {_SUM.format('l_extendedprice')} as sales from lineitem join part on l_partkey = p_partkey group by all)) where place <= 3",
)
def top_n_per_group(spark, sf_dir):
    """Sums come before the join, so only one row per part is shuffled to its brand."""
    sales = tpch.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(_sum("l_extendedprice").alias("sales"))
    parts = tpch.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("sales"), "l_partkey"))
    return (
        sales.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("place", place).where("place <= 3")
        .select("p_brand", F.col("place").cast("bigint").alias("place"), "l_partkey", "sales")
    )


@register(
    "share_of_total",
    f"select c_nationkey, sales, round(sales / sum(sales) over () * 100, 6) as percentage from (select c_nationkey, sum(o_totalprice::{_MONEY}) as sales "
    "from orders join customer on o_custkey = c_custkey group by 1)".replace("select c_nationkey, sales,", "select c_nationkey, sales::double as sales,", 1),
)
def share_of_total(spark, sf_dir):
    """The grand total is one row, joined to the groups rather than windowed over them."""
    by_customer = tpch.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("s"))
    customers = tpch.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    groups = by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("s").alias("sales"))
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("sales").alias("total"))
    share = F.col("sales").cast("double") / F.col("total").cast("double")
    # One row.
    return groups.join(F.broadcast(total)).select("c_nationkey", F.col("sales").cast("double").alias("sales"), F.round(share * 100, 6).alias("percentage"))


@register(
    "pivot",
    "select p_type, " + ", ".join(
        f"coalesce({_SUM.format(f'case when quarter(l_shipdate) = {q} then l_extendedprice end')}, 0) as q{q}" for q in (1, 2, 3, 4)
    ) + " from lineitem join part on l_partkey = p_partkey group by 1",
)
def pivot(spark, sf_dir):
    lines = tpch.table(spark, sf_dir, "lineitem").select("l_partkey", F.quarter("l_shipdate").alias("q"), _money("l_extendedprice").alias("price"))
    by_part = lines.groupBy("l_partkey", "q").agg(F.sum("price").alias("price"))
    parts = tpch.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    wide = by_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").pivot("q", [1, 2, 3, 4]).agg(F.sum("price"))
    return wide.select("p_type", *(F.coalesce(F.col(str(q)), F.lit(0)).cast("double").alias(f"q{q}") for q in (1, 2, 3, 4)))


@register(
    "stats",
    "select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, min(l_quantity) as lowest, max(l_quantity) as highest, "
    "round(stddev_pop(l_quantity), 6) as deviation, median(l_quantity) as median from lineitem group by 1",
)
def stats(spark, sf_dir):
    """The exact median comes from counts per value, so no task sorts a whole group."""
    counts = tpch.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.count("*").alias("c"))
    v, c = F.col("v"), F.col("c")
    n = F.sum(c)
    mean = F.sum(v * c) / n
    variance = F.sum(v * v * c) / n - mean * mean
    return counts.groupBy("l_returnflag").agg(
        n.alias("n"), F.round(mean, 6).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.round(F.sqrt(variance), 6).alias("deviation"), F.percentile(v, F.lit(0.5), c).alias("median"),
    )


@register(
    "hierarchical",
    "select department, count(*) as teams, sum(size)::bigint as people, round(avg(average), 6) as average, "
    "string_agg(team || ':' || size, ',' order by team) as listed from "
    f"(select c_mktsegment as department, c_nationkey::varchar as team, count(*) as size, round({_SUM.format('c_acctbal')} / count(*), 6) as average from customer group by all) group by 1",
)
def hierarchical(spark, sf_dir):
    teams = tpch.table(spark, sf_dir, "customer").groupBy(
        F.col("c_mktsegment").alias("department"), F.col("c_nationkey").cast("string").alias("team")
    ).agg(F.count("*").alias("size"), _mean(F.sum(_money("c_acctbal")), F.count("*")).alias("average"))
    entry = F.struct("team", F.concat("team", F.lit(":"), F.col("size").cast("string")).alias("t"))
    # One entry per nation at most.
    listed = F.array_join(F.sort_array(F.collect_list(entry))["t"], ",")
    return teams.groupBy("department").agg(
        F.count("*").alias("teams"), F.sum("size").alias("people"), F.round(F.avg("average"), 6).alias("average"), listed.alias("listed")
    )


@register(
    "multi_facet",
    "select 'status' as facet, o_orderstatus as label, count(*) as n from orders group by all union all "
    "select 'priority', o_orderpriority, count(*) from orders group by all union all "
    "select 'year', year(o_orderdate)::varchar, count(*) from orders group by all",
)
def multi_facet(spark, sf_dir):
    """Several summaries of one input from a single pass with grouping sets."""
    orders = tpch.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), tpch.year_of("o_orderdate").alias("year")
    )
    facets = ["status", "priority", "year"]
    grouped = orders.groupingSets([[F.col(f)] for f in facets], *(F.col(f) for f in facets)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # Bits of the grouping id are set for the columns left out.
    facet = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "priority").otherwise("year")
    return grouped.select(facet.alias("facet"), F.coalesce(*facets).alias("label"), "n")


@register(
    "page_with_total",
    "select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'O') as total, "
    "(select count(*) from orders where o_orderstatus = 'O') > 30 as has_more from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 10 offset 20",
)
def page_with_total(spark, sf_dir):
    """The third page of ten; the total is a single row."""
    rows = tpch.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)
    total = rows.agg(F.count("*").alias("total")).scalar()
    return page.withColumn("total", total).withColumn("has_more", F.col("total") > 30)


@register(
    "bucket",
    "select bucket, count(*) as customers, round(sum(spent)::double / count(*), 6) as average from (select spent, case when spent < 0 then 'other' when spent < 500000 then '0' "
    "when spent < 1000000 then '500000' when spent < 2000000 then '1000000' when spent < 5000000 then '2000000' else '5000000' end as bucket "
    f"from (select o_custkey, sum(o_totalprice::{_MONEY}) as spent from orders group by 1)) group by 1",
)
def bucket(spark, sf_dir):
    spent = F.col("spent")
    label = F.when(spent < 0, "other")
    for low, high in ((0, 500_000), (500_000, 1_000_000), (1_000_000, 2_000_000), (2_000_000, 5_000_000)):
        label = label.when(spent < high, str(low))
    per_customer = tpch.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("spent"))
    return per_customer.groupBy(label.otherwise("5000000").alias("bucket")).agg(
        F.count("*").alias("customers"), _mean(F.sum("spent"), F.count("*")).alias("average")
    )


@register(
    "ab_rates",
    "select case when user_id % 2 = 0 then 'control' else 'treatment' end as variant, strftime(ts, '%Y-%m-%d') as day, count(*) as users, "
    "count_if(event_type = 'purchase')::bigint as conversions, round(count_if(event_type = 'purchase') / count(*), 6) as rate, "
    f"round({_SUM.format('value')} / count(*), 6) as average_value from events group by all",
)
def ab_rates(spark, sf_dir):
    variant = F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment")
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    conversions = F.count_if(F.col("event_type") == "purchase")
    return tpch.table(spark, sf_dir, "events").groupBy(variant.alias("variant"), day.alias("day")).agg(
        F.count("*").alias("users"), conversions.alias("conversions"), F.round(conversions / F.count("*"), 6).alias("rate"),
        _mean(F.sum(_money("value")), F.count("*")).alias("average_value"),
    )


_SCORE_SQL = "select user_id, count_if(event_type = 'view') * 2 + count_if(event_type = 'click') * 3 + count_if(event_type = 'purchase') * 8 as score, count(*) as n from events group by 1"


@register("engagement_score", f"select user_id, score::bigint as score, n from ({_SCORE_SQL}) order by score desc, user_id limit 25")
def engagement_score(spark, sf_dir):
    def seen(kind):
        return F.count_if(F.col("event_type") == kind)

    score = seen("view") * 2 + seen("click") * 3 + seen("purchase") * 8
    per_user = tpch.table(spark, sf_dir, "events").groupBy("user_id").agg(score.alias("score"), F.count("*").alias("n"))
    return per_user.orderBy(F.desc("score"), "user_id").limit(25)


@register(
    "engagement_by_weekday",
    f"select dayofweek(ts)::int + 1 as weekday, count(*) as n, round({_SUM.format('value')} / count(*), 6) as average from events group by 1",
)
def engagement_by_weekday(spark, sf_dir):
    return tpch.table(spark, sf_dir, "events").groupBy(F.dayofweek("ts").alias("weekday")).agg(
        F.count("*").alias("n"), _mean(F.sum(_money("value")), F.count("*")).alias("average")
    )


@register(
    "theta_lookup",
    "select o_orderkey, count(p_partkey) as available, coalesce(min(p_partkey), -1) as first_part from orders left join "
    "(select distinct l_orderkey, l_partkey, l_shipdate from lineitem) on l_orderkey = o_orderkey and l_shipdate <= o_orderdate + interval 60 days "
    "left join part on p_partkey = l_partkey group by 1",
)
def theta_lookup(spark, sf_dir):
    """Membership as an equi-join, the date bound as a condition on the joined pair."""
    lines = tpch.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").distinct()
    orders = tpch.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = tpch.table(spark, sf_dir, "part").select("p_partkey")
    on = F.expr("l_orderkey = o_orderkey and l_shipdate <= o_orderdate + interval 60 days")
    joined = orders.join(lines, on, "left").join(parts, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy("o_orderkey").agg(
        F.count("p_partkey").alias("available"), F.coalesce(F.min("p_partkey"), F.lit(-1)).cast("bigint").alias("first_part")
    )


@register(
    "conditional_lookup",
    "select c_custkey, c_mktsegment, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey and "
    "(c_mktsegment = 'BUILDING' or o_totalprice >= 400000) group by all",
)
def conditional_lookup(spark, sf_dir):
    on = F.expr("o_custkey = c_custkey and (c_mktsegment = 'BUILDING' or o_totalprice >= 400000)")
    customers = tpch.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = tpch.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return customers.join(orders, on, "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("orders"))


@register(
    "self_lookup",
    "select m.p_partkey as manager, count(r.p_partkey) as reports, coalesce(min(r.p_name), '') as first_report from part m left join part r "
    "on r.p_partkey // 7 = m.p_partkey and r.p_partkey <> m.p_partkey group by 1",
)
def self_lookup(spark, sf_dir):
    """Each part reports to the part with a seventh of its number."""
    parts = tpch.table(spark, sf_dir, "part")
    managers = parts.select(F.col("p_partkey").alias("manager"))
    reports = parts.select(F.expr("p_partkey div 7").alias("_of"), "p_partkey", "p_name").where("_of <> p_partkey")
    return managers.join(reports, F.col("_of") == F.col("manager"), "left").groupBy("manager").agg(
        F.count("p_partkey").alias("reports"), F.coalesce(F.min("p_name"), F.lit("")).alias("first_report")
    )


@register(
    "m2m_lookup",
    "select s_name, p_brand, count(*) as parts from (select distinct l_suppkey, l_partkey from lineitem) join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by all",
)
def m2m_lookup(spark, sf_dir):
    bridge = tpch.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    suppliers = tpch.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    parts = tpch.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = bridge.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("s_name", "p_brand").agg(F.count("*").alias("parts"))


@register(
    "unwind_options",
    "with words as (select p_partkey, case when p_size < 5 then [] when p_size < 10 then null else string_split(p_name, ' ') end as w from part) "
    "select p_partkey, u.pos::int as pos, u.word from words left join (select p_partkey, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from words) u using (p_partkey)",
)
def unwind_options(spark, sf_dir):
    """Rows with an empty or missing list stay; elements come with their index."""
    words = F.when(F.col("p_size") < 5, F.array().cast("array<string>")).when(F.col("p_size") >= 10, F.split("p_name", " "))
    rows = tpch.table(spark, sf_dir, "part").select("p_partkey", words.alias("w"))
    return rows.select("p_partkey", F.posexplode_outer("w").alias("pos", "word"))


@register(
    "unwind_nested",
    "select word, letter, count(*) as n from (select word, unnest(string_split(word, '')) as letter from (select unnest(string_split(p_name, ' ')) as word from part)) group by all",
)
def unwind_nested(spark, sf_dir):
    words = tpch.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    letters = words.select("word", "c", F.explode(F.expr("filter(split(word, ''), x -> x <> '')")).alias("letter"))
    return letters.groupBy("word", "letter").agg(F.sum("c").alias("n"))


@register(
    "null_group",
    "select case when l_linenumber < 3 then null else l_returnflag end as flag, count(*) as n, count(case when l_tax > 0.04 then l_tax end) as taxed, "
    "round(avg(case when l_tax > 0.04 then l_tax end), 6) as average from lineitem group by 1",
)
def null_group(spark, sf_dir):
    flag = F.when(F.col("l_linenumber") >= 3, F.col("l_returnflag"))
    tax = F.when(F.col("l_tax") > 0.04, F.col("l_tax"))
    return tpch.table(spark, sf_dir, "lineitem").groupBy(flag.alias("flag")).agg(
        F.count("*").alias("n"), F.count(tax).alias("taxed"), F.round(F.avg(tax), 6).alias("average")
    )
