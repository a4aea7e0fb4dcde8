"""The registered queries, one or more per operator, over the whole test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.display import duration_text, percent_text, preview, time_text, value_text
from tallyscope.operators.categories import bar_totals, by_falling_total, category_label
from tallyscope.operators.extent import column_overview
from tallyscope.operators.selection import Between, ValueIs
from tallyscope.plans import checks
from tallyscope.plans.registry import query, session
from tallyscope.plans.session import Session
from tallyscope.sources import sinks
from tallyscope.sources.scratch import scratch_path
from tallyscope.sources.tables import column_names, read_query, register

DAY = dt.datetime

# -- row count and status --------------------------------------------------


@query(
    "row_count",
    "select count(*) as \"count\" from lineitem where l_returnflag = 'A' and l_quantity between 10 and 20",
)
def row_count(spark, folder):
    return _flag_and_quantity(session(spark, folder, "lineitem")).count()


@query("status_count", checks.status("lineitem", "l_returnflag = 'A' and l_quantity between 10 and 20"))
def status_count(spark, folder):
    return _flag_and_quantity(session(spark, folder, "lineitem")).status()


@query("status_all", checks.status("orders", "true"))
def status_all(spark, folder):
    return session(spark, folder, "orders").status()


def _flag_and_quantity(s: Session) -> Session:
    return s.where_value("l_returnflag", "A").where_range("l_quantity", 10.0, 20.0)


# -- histograms ------------------------------------------------------------


@query("hist_price", checks.number_histogram("lineitem", "l_extendedprice"))
def hist_price(spark, folder):
    return session(spark, folder, "lineitem").histogram("l_extendedprice")


@query("hist_acctbal_negative", checks.number_histogram("customer", "c_acctbal"))
def hist_acctbal_negative(spark, folder):
    return session(spark, folder, "customer").histogram("c_acctbal")


@query("hist_edge_max", checks.number_histogram("lineitem", "l_quantity"))
def hist_edge_max(spark, folder):
    return session(spark, folder, "lineitem").histogram("l_quantity")


@query("hist_integer", checks.number_histogram("part", "p_size"))
def hist_integer(spark, folder):
    return session(spark, folder, "part").histogram("p_size")


@query("hist_small_step", checks.number_histogram("lineitem", "l_tax"))
def hist_small_step(spark, folder):
    return session(spark, folder, "lineitem").histogram("l_tax")


@query("hist_decimal", checks.number_histogram("orders", "cast(o_totalprice as decimal(12,2))"))
def hist_decimal(spark, folder):
    s = session(spark, folder, "orders", "CAST(o_totalprice AS DECIMAL(12,2)) AS price")
    return s.histogram("price")


@query(
    "hist_null_bin",
    checks.number_histogram("customer", "case when c_mktsegment <> 'BUILDING' then c_acctbal end"),
)
def hist_null_bin(spark, folder):
    s = session(
        spark, folder, "customer", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS bal"
    )
    return s.histogram("bal")


_ODD = (
    "case l_linenumber when 7 then {nan} when 6 then {inf} when 5 then {minf} "
    "when 4 then null else l_extendedprice end"
)


@query(
    "hist_nonfinite",
    checks.number_histogram(
        "lineitem",
        _ODD.format(
            nan="'NaN'::double", inf="'Infinity'::double", minf="'-Infinity'::double"
        ),
    ),
)
def hist_nonfinite(spark, folder):
    odd = _ODD.format(
        nan="double('NaN')", inf="double('Infinity')", minf="double('-Infinity')"
    )
    return session(spark, folder, "lineitem", f"{odd} AS x").histogram("x")


@query("hist_constant", checks.number_histogram("orders", "o_totalprice * 0 + 7.25"))
def hist_constant(spark, folder):
    return session(spark, folder, "orders", "o_totalprice * 0 + 7.25D AS x").histogram("x")


@query("hist_all_null", "select 'null' kind, cast(null as double) x1, cast(null as double) x2, count(*) n from part")
def hist_all_null(spark, folder):
    s = session(spark, folder, "part", "CASE WHEN p_size < 0 THEN p_retailprice END AS x")
    return s.histogram("x")


@query("hist_orderdate_quarter", checks.date_histogram("orders", "o_orderdate", "3 months"))
def hist_orderdate_quarter(spark, folder):
    return session(spark, folder, "orders").histogram("o_orderdate")


@query("hist_events_2day", checks.date_histogram("events", "ts", "2 days"))
def hist_events_2day(spark, folder):
    return session(spark, folder, "events").histogram("ts")


@query("hist_date_type", checks.date_histogram("orders", "cast(o_orderdate as date)", "3 months"))
def hist_date_type(spark, folder):
    s = session(spark, folder, "orders", "CAST(o_orderdate AS DATE) AS d")
    return s.histogram("d")


@query(
    "hist_decades",
    checks.date_histogram(
        "orders",
        "o_orderdate - case o_orderpriority when '5-LOW' then interval '150 years' "
        "else interval '0 years' end",
        "10 years",
    ),
)
def hist_decades(spark, folder):
    s = session(
        spark, folder, "orders",
        "o_orderdate - CASE o_orderpriority WHEN '5-LOW' THEN INTERVAL '150' YEAR "
        "ELSE INTERVAL '0' YEAR END AS d",
    )
    return s.histogram("d")


@query(
    "hist_hours",
    checks.date_histogram("events", "timestamp '2024-01-01' + (ts - date_trunc('day', ts))", "1 hour"),
)
def hist_hours(spark, folder):
    s = session(
        spark, folder, "events",
        "timestamp_ntz'2024-01-01 00:00:00' + (ts - date_trunc('DAY', ts)) AS at",
    )
    return s.histogram("at")


@query(
    "hist_date_null",
    checks.date_histogram("orders", "case when o_orderstatus <> 'F' then o_orderdate end", "3 months"),
)
def hist_date_null(spark, folder):
    s = session(
        spark, folder, "orders", "CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS d"
    )
    return s.histogram("d")


# -- value counts ----------------------------------------------------------


@query("vc_linestatus", checks.value_counts("lineitem", "l_linestatus"))
def vc_linestatus(spark, folder):
    return session(spark, folder, "lineitem").value_counts("l_linestatus")


@query("vc_segment_null", checks.value_counts("customer", "nullif(c_mktsegment, 'BUILDING')"))
def vc_segment_null(spark, folder):
    s = session(spark, folder, "customer", "nullif(c_mktsegment, 'BUILDING') AS seg")
    return s.value_counts("seg")


@query("vc_props", checks.value_counts("events", "props"))
def vc_props(spark, folder):
    return session(spark, folder, "events").value_counts("props")


@query("vc_doc_text", checks.value_counts("documents", "text"))
def vc_doc_text(spark, folder):
    return session(spark, folder, "documents").value_counts("text")


@query("vc_doc_text_hashed", checks.value_counts("documents", "text", "lang <> 'en'"))
def vc_doc_text_hashed(spark, folder):
    s = session(spark, folder, "documents", "text", "lang <> 'en' AS other")
    return s.where_value("other", "true").value_counts("text")


@query("vc_html_hashed", checks.value_counts("pages", "html"))
def vc_html_hashed(spark, folder):
    return session(spark, folder, "pages").value_counts("html")


@query("vc_all_unique", checks.value_counts("customer", "c_name"))
def vc_all_unique(spark, folder):
    return session(spark, folder, "customer").value_counts("c_name")


@query("vc_bool", checks.value_counts("customer", "c_acctbal > 0"))
def vc_bool(spark, folder):
    return session(spark, folder, "customer", "c_acctbal > 0 AS f").value_counts("f")


@query("vc_integer", checks.value_counts("labels", "quality * 10 + toxic"))
def vc_integer(spark, folder):
    return session(spark, folder, "labels", "quality * 10 + toxic AS q").value_counts("q")


@query("vc_int_list", checks.value_counts("nation", "'[' || n_regionkey || ',' || n_regionkey % 2 || ']'"))
def vc_int_list(spark, folder):
    s = session(spark, folder, "nation", "array(n_regionkey, n_regionkey % 2) AS a")
    return s.value_counts("a")


@query("vc_binary", checks.value_counts("part", "hex(encode(p_type))"))
def vc_binary(spark, folder):
    return session(spark, folder, "part", "CAST(p_type AS BINARY) AS b").value_counts("b")


@query("vc_filtered_singles", checks.value_counts("events", "user_id", '"value" between 150 and 1e9'))
def vc_filtered_singles(spark, folder):
    s = session(spark, folder, "events").where_range("value", 150.0, 1e9)
    return s.value_counts("user_id")


@query("vc_markers", checks.value_counts("orders", "case o_orderstatus when 'F' then 'null' when 'O' then 'unique' end"))
def vc_markers(spark, folder):
    s = session(
        spark, folder, "orders",
        "CASE o_orderstatus WHEN 'F' THEN 'null' WHEN 'O' THEN 'unique' END AS s",
    )
    return s.value_counts("s")


@query("vc_by_falling_total", checks.value_counts("part", "p_brand"))
def vc_by_falling_total(spark, folder):
    return by_falling_total(session(spark, folder, "part").value_counts("p_brand"))


@query("top20_rest", checks.top_values("events", "props"))
def top20_rest(spark, folder):
    return session(spark, folder, "events").top_values("props")


@query("top20_rest_filtered", checks.top_values("events", "props", "event_type = 'click'"))
def top20_rest_filtered(spark, folder):
    return session(spark, folder, "events").where_value("event_type", "click").top_values("props")


@query("top1000_props", checks.top_values("events", "props", "event_type = 'click'", 1000))
def top1000_props(spark, folder):
    return session(spark, folder, "events").where_value("event_type", "click").top_values("props", 1000)


@query("top1000_customers", checks.top_values("orders", "o_custkey", "o_orderstatus = 'F'", 1000))
def top1000_customers(spark, folder):
    s = session(spark, folder, "orders", "CAST(o_custkey AS STRING) AS customer", "o_orderstatus")
    return s.where_value("o_orderstatus", "F").top_values("customer", 1000)


@query("top20_doc_text", checks.top_values("documents", "case when source <> 'src0' then text end"))
def top20_doc_text(spark, folder):
    s = session(spark, folder, "documents", "CASE WHEN source <> 'src0' THEN text END AS text")
    return s.top_values("text")


@query("top20_html_hashed", checks.top_values("pages", "case when page_id % 7 <> 0 then html end", "url like 'https%'"))
def top20_html_hashed(spark, folder):
    s = session(
        spark, folder, "pages", "CASE WHEN page_id % 7 <> 0 THEN html END AS html",
        "url LIKE 'https%' AS safe",
    )
    return s.where_value("safe", "true").top_values("html")


@query("bar_totals", checks.bar_totals("documents", "text"))
def bar_totals_text(spark, folder):
    return bar_totals(session(spark, folder, "documents").value_counts("text"))


@query("bar_totals_null", checks.bar_totals("customer", "nullif(c_mktsegment, 'BUILDING')"))
def bar_totals_null(spark, folder):
    s = session(spark, folder, "customer", "nullif(c_mktsegment, 'BUILDING') AS seg")
    return bar_totals(s.value_counts("seg"))


@query("category_label", checks.category_label("documents", "text"))
def category_label_text(spark, folder):
    return category_label(session(spark, folder, "documents").value_counts("text"))


@query("category_label_one", checks.category_label("region", "'x'"))
def category_label_one(spark, folder):
    s = session(spark, folder, "region", "'x' AS s")
    return category_label(s.value_counts("s"))


# -- cross-filter ----------------------------------------------------------

_FLAG = "l_returnflag = 'A'"
_QTY = "l_quantity between 10 and 20"
_SHIP = "l_shipdate between timestamp '1996-01-01' and timestamp '1998-12-31'"


def _three(spark, folder) -> Session:
    s = _flag_and_quantity(session(spark, folder, "lineitem"))
    return s.where_range("l_shipdate", DAY(1996, 1, 1), DAY(1998, 12, 31))


@query("cf_flag", checks.value_counts("lineitem", "l_returnflag", f"{_QTY} and {_SHIP}"))
def cf_flag(spark, folder):
    return _three(spark, folder).value_counts("l_returnflag")


@query("cf_linestatus", checks.value_counts("lineitem", "l_linestatus", f"{_FLAG} and {_QTY} and {_SHIP}"))
def cf_linestatus(spark, folder):
    return _three(spark, folder).value_counts("l_linestatus")


@query("cf_qty", checks.number_histogram("lineitem", "l_quantity", f"{_FLAG} and {_SHIP}"))
def cf_qty(spark, folder):
    return _three(spark, folder).histogram("l_quantity")


@query("cf_ship", checks.date_histogram("lineitem", "l_shipdate", "3 months", f"{_FLAG} and {_QTY}"))
def cf_ship(spark, folder):
    return _three(spark, folder).histogram("l_shipdate")


@query("cf_price", checks.number_histogram("lineitem", "l_extendedprice", f"{_FLAG} and {_QTY} and {_SHIP}"))
def cf_price(spark, folder):
    return _three(spark, folder).histogram("l_extendedprice")


@query("cf_count", f'select count(*) as "count" from lineitem where {_FLAG} and {_QTY} and {_SHIP}')
def cf_count(spark, folder):
    return _three(spark, folder).count()


@query("cf_cleared", checks.value_counts("lineitem", "l_linestatus", _SHIP))
def cf_cleared(spark, folder):
    s = _three(spark, folder).toggle(ValueIs("l_returnflag", "A")).clear("l_quantity")
    return s.value_counts("l_linestatus")


@query("cf_reset", 'select count(*) as "count" from lineitem')
def cf_reset(spark, folder):
    return _three(spark, folder).clear().count()


@query("frac_returnflag", checks.value_counts_compare("lineitem", "l_returnflag", f"{_QTY} and {_SHIP}"))
def frac_returnflag(spark, folder):
    return _three(spark, folder).value_counts_compare("l_returnflag")


@query("frac_shipdate", checks.value_counts_compare("lineitem", "cast(l_shipdate as date)", f"{_FLAG} and {_QTY}"))
def frac_shipdate(spark, folder):
    s = session(
        spark, folder, "lineitem", "CAST(l_shipdate AS DATE) AS day", "l_returnflag", "l_quantity"
    )
    return _flag_and_quantity(s).value_counts_compare("day")


@query("hist_compare", checks.number_compare("lineitem", "l_extendedprice", f"{_FLAG} and {_QTY} and {_SHIP}"))
def hist_compare(spark, folder):
    return _three(spark, folder).histogram_compare("l_extendedprice")


@query("hist_compare_date", checks.date_compare("lineitem", "l_shipdate", "3 months", f"{_FLAG} and {_QTY}"))
def hist_compare_date(spark, folder):
    return _three(spark, folder).histogram_compare("l_shipdate")


# -- clauses over rows -----------------------------------------------------


@query(
    "unique_rows",
    "select * from documents where text in "
    "(select text from documents group by text having count(*) = 1)",
)
def unique_rows(spark, folder):
    return session(spark, folder, "documents").where_unique("text").data()


@query(
    "unique_then_lang",
    checks.value_counts(
        "documents", "lang",
        "text in (select text from documents group by text having count(*) = 1)",
    ),
)
def unique_then_lang(spark, folder):
    return session(spark, folder, "documents").where_unique("text").value_counts("lang")


@query(
    "unique_compare",
    checks.value_counts_compare(
        "documents", "lang",
        "text in (select text from documents group by text having count(*) = 1)",
    ),
)
def unique_compare(spark, folder):
    return session(spark, folder, "documents").where_unique("text").value_counts_compare("lang")


@query("null_point", "select * from (select c_custkey, nullif(c_mktsegment, 'BUILDING') seg from customer) where seg is null")
def null_point(spark, folder):
    s = session(spark, folder, "customer", "c_custkey", "nullif(c_mktsegment, 'BUILDING') AS seg")
    return s.where_value("seg", None).data()


@query("range_point", "select * from orders where o_totalprice between 100000 and 200000 and o_orderstatus = 'F'")
def range_point(spark, folder):
    s = session(spark, folder, "orders").where_range("o_totalprice", 100000, 200000)
    return s.where_value("o_orderstatus", "F").data()


@query("point_integer", "select * from part where p_size = 7")
def point_integer(spark, folder):
    return session(spark, folder, "part").where_value("p_size", "7").data()


@query("point_bool", "select c_custkey, c_acctbal > 0 as f from customer where c_acctbal > 0")
def point_bool(spark, folder):
    s = session(spark, folder, "customer", "c_custkey", "c_acctbal > 0 AS f")
    return s.where_value("f", "true").data()


# -- rows, pages and row numbers ------------------------------------------

_PAGE = (
    "select * from orders order by o_totalprice desc nulls last, o_orderdate asc nulls last, "
    "o_orderkey, o_custkey, o_orderstatus, o_orderpriority limit 100 offset 200"
)


@query("rows_page", _PAGE)
def rows_page(spark, folder):
    s = session(spark, folder, "orders").sort("o_orderdate", "asc").sort("o_totalprice", "desc")
    return s.page(2)


_NULL_SEG = "select c_custkey, nullif(c_mktsegment, 'BUILDING') seg, c_acctbal from customer"


@query(
    "rows_page_nulls",
    f"select * from ({_NULL_SEG}) where c_acctbal < 500 order by seg desc nulls last, c_custkey limit 100 offset 100",
)
def rows_page_nulls(spark, folder):
    s = session(
        spark, folder, "customer",
        "c_custkey", "nullif(c_mktsegment, 'BUILDING') AS seg", "c_acctbal",
    )
    return s.where_range("c_acctbal", -1e9, 500.0, include_hi=False).sort("seg", "desc").page(1)


@query(
    "rows_numbered_page",
    f"select *, 200 + row_number() over (order by o_totalprice desc, o_orderkey) - 1 as \"row\" from ({_PAGE})",
)
def rows_numbered_page(spark, folder):
    s = session(spark, folder, "orders").sort("o_totalprice", "desc").sort("o_orderdate", "asc")
    return s.numbered_page(2)


@query(
    "rows_numbered",
    "select *, row_number() over (order by o_orderpriority desc, o_orderkey) - 1 as \"row\" from orders",
)
def rows_numbered(spark, folder):
    return session(spark, folder, "orders").sort("o_orderpriority", "desc").numbered("row")


@query(
    "rows_after_seek",
    "select * from lineitem order by l_shipdate desc nulls last, l_orderkey, l_partkey, l_suppkey, "
    "l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus "
    "limit 100 offset 300",
)
def rows_after_seek(spark, folder):
    s = session(spark, folder, "lineitem").sort("l_shipdate", "desc")
    last = s.page(2).tail(1)[0]
    return s.page_after(last)


@query(
    "rows_after_seek_duplicates",
    "select l_returnflag, l_linestatus from lineitem order by l_returnflag, l_linestatus limit 100 offset 500",
)
def rows_after_seek_duplicates(spark, folder):
    """The page after five pages of which most rows are equal."""
    s = session(spark, folder, "lineitem", "l_returnflag", "l_linestatus").sort("l_returnflag", "asc")
    given = s.page(0, 500).collect()
    return s.page_after(given[-1], shown=given.count(given[-1]))


@query("rows_columns", "select l_shipdate, l_orderkey from lineitem where l_linenumber = 3")
def rows_columns(spark, folder):
    path = f"{folder}/lineitem.parquet"
    s = Session.of_file(spark, path, columns=["l_shipdate", "l_orderkey", "l_linenumber"])
    return s.where_value("l_linenumber", "3").data().drop("l_linenumber")


@query(
    "data_view",
    f"select * from lineitem where {_FLAG} and {_QTY} and {_SHIP} order by l_shipdate",
)
def data_view(spark, folder):
    return _three(spark, folder).sort("l_shipdate", "asc").data()


@query("sql_view", f"select * from lineitem where {_FLAG} and {_QTY} and {_SHIP}")
def sql_view(spark, folder):
    return read_query(spark, _three(spark, folder).sort("l_shipdate", "desc").sql())


@query(
    "sql_view_unique",
    "select * from documents where lang = 'de' and text in "
    "(select text from documents group by text having count(*) = 1)",
)
def sql_view_unique(spark, folder):
    s = session(spark, folder, "documents").where_unique("text").where_value("lang", "de")
    return read_query(spark, s.sql())


@query("sql_export", f"select * from lineitem where {_FLAG} and {_QTY} and {_SHIP}")
def sql_export(spark, folder):
    return read_query(spark, _three(spark, folder).export_sql())


# -- whole-table profile ---------------------------------------------------

_PART = [
    ("p_partkey", "int64", "number", None),
    ("p_name", "utf8", "category", None),
    ("p_brand", "utf8", "category", None),
    ("p_type", "utf8", "category", None),
    ("p_size", "int32", "number", None),
    ("p_retailprice", "float64", "number", None),
]
_LINEITEM = [
    ("l_orderkey", "int64", "number", None),
    ("l_partkey", "int64", "number", None),
    ("l_suppkey", "int64", "number", None),
    ("l_linenumber", "int32", "number", None),
    ("l_quantity", "float64", "number", None),
    ("l_extendedprice", "float64", "number", None),
    ("l_discount", "float64", "number", None),
    ("l_tax", "float64", "number", None),
    ("l_returnflag", "utf8", "category", None),
    ("l_linestatus", "utf8", "category", None),
    ("l_shipdate", "timestamp", "date", "3 months"),
]
_DOCUMENTS = [
    ("doc_id", "int64", "number", None),
    ("text", "utf8", "category", None),
    ("lang", "utf8", "category", None),
    ("source", "utf8", "category", None),
    ("n_chars", "int64", "number", None),
]
_EVENTS = [
    ("event_id", "int64", "number", None),
    ("ts", "timestamp", "date", "2 days"),
    ("user_id", "int64", "number", None),
    ("event_type", "utf8", "category", None),
    ("value", "float64", "number", None),
    ("props", "utf8", "category", None),
]


@query("profile_part", checks.profile("part", _PART, {}))
def profile_part(spark, folder):
    return session(spark, folder, "part").profile()


@query("profile_lineitem", checks.profile("lineitem", _LINEITEM, {}))
def profile_lineitem(spark, folder):
    return session(spark, folder, "lineitem").profile()


@query(
    "profile_lineitem_filtered",
    checks.profile(
        "lineitem", _LINEITEM,
        {"l_returnflag": _FLAG, "l_quantity": _QTY, "l_shipdate": _SHIP},
    ),
)
def profile_lineitem_filtered(spark, folder):
    return _three(spark, folder).profile()


@query("profile_documents", checks.profile("documents", _DOCUMENTS, {"lang": "lang = 'en'"}))
def profile_documents(spark, folder):
    return session(spark, folder, "documents").where_value("lang", "en").profile()


@query("profile_documents_hashed", checks.profile("documents", _DOCUMENTS, {"lang": "lang = 'en'"}))
def profile_documents_hashed(spark, folder):
    s = session(spark, folder, "documents").where_value("lang", "en")
    return s.profile()


@query(
    "profile_events_unique",
    checks.profile(
        "events", _EVENTS,
        {
            "event_type": "event_type = 'click'",
            "user_id": "user_id in (select user_id from events group by user_id having count(*) = 1)",
        },
    ),
)
def profile_events_unique(spark, folder):
    s = session(spark, folder, "events").where_value("event_type", "click")
    return s.where_unique("user_id").profile()


@query("column_overview", checks.overview("lineitem", _LINEITEM))
def overview_lineitem(spark, folder):
    return column_overview(session(spark, folder, "lineitem").base)


@query("column_overview_text", checks.overview("documents", _DOCUMENTS))
def overview_documents(spark, folder):
    return column_overview(session(spark, folder, "documents").base)


@query(
    "profile_minmax",
    "select cast(0 as int) pos, 'x' as \"column\", 'float64' type_name, 'number' as role, "
    "true as nullable, count(*) n_rows, "
    "cast(count(*) filter (where l_linenumber = 4) as bigint) n_null, "
    "cast(count(*) filter (where l_linenumber in (5, 6, 7)) as bigint) n_nonfinite, "
    "min(l_extendedprice) filter (where l_linenumber < 4) lo, "
    "max(l_extendedprice) filter (where l_linenumber < 4) hi, "
    "cast(null as timestamp) t_lo, cast(null as timestamp) t_hi from lineitem",
)
def profile_minmax(spark, folder):
    odd = _ODD.format(
        nan="double('NaN')", inf="double('Infinity')", minf="double('-Infinity')"
    )
    return column_overview(session(spark, folder, "lineitem", f"{odd} AS x").base)


# -- cube ------------------------------------------------------------------


@query("cube_qty_flag", checks.value_counts("lineitem", "l_returnflag", "l_quantity >= 10 and l_quantity < 25"))
def cube_qty_flag(spark, folder):
    cube = session(spark, folder, "lineitem").cube("l_quantity", ["l_returnflag"])
    return cube.value_counts("l_returnflag", Between("l_quantity", 10.0, 25.0, include_hi=False))


@query(
    "cube_flag_price",
    checks.number_histogram("lineitem", "l_extendedprice", f"{_FLAG} and {_SHIP}"),
)
def cube_flag_price(spark, folder):
    s = session(spark, folder, "lineitem")
    s = s.where_range("l_shipdate", DAY(1996, 1, 1), DAY(1998, 12, 31))
    cube = s.cube("l_returnflag", ["l_extendedprice", "l_linestatus"])
    return cube.histogram("l_extendedprice", ValueIs("l_returnflag", "A"))


@query(
    "cube_ship_tax",
    checks.number_histogram(
        "lineitem", "l_tax",
        "l_shipdate >= timestamp '1996-04-01' and l_shipdate < timestamp '1997-07-01'",
    ),
)
def cube_ship_tax(spark, folder):
    cube = session(spark, folder, "lineitem").cube("l_shipdate", ["l_tax"])
    return cube.histogram(
        "l_tax", Between("l_shipdate", DAY(1996, 4, 1), DAY(1997, 7, 1), include_hi=False)
    )


_MOVED = "l_quantity >= 10 and l_quantity < 25 and l_linestatus = 'F'"


@query(
    "cube_refresh",
    f"""
select 'l_discount' as "column", kind, cast(null as varchar) as "key", x1, x2,
       cast(null as timestamp) t1, cast(null as timestamp) t2, n total
from ({checks.number_histogram("lineitem", "l_discount", _MOVED)})
union all
select 'l_shipdate', kind, null, null, null, x1, x2, n
from ({checks.date_histogram("lineitem", "l_shipdate", "3 months", _MOVED)})
union all
select 'l_returnflag', kind, "key", null, null, null, null, total
from ({checks.value_counts("lineitem", "l_returnflag", _MOVED)})
union all
select 'l_linestatus', kind, "key", null, null, null, null, total
from ({checks.value_counts("lineitem", "l_linestatus", "l_quantity >= 10 and l_quantity < 25")})
""",
)
def cube_refresh(spark, folder):
    s = session(spark, folder, "lineitem").where_value("l_linestatus", "F")
    cube = s.cube("l_quantity", ["l_discount", "l_shipdate", "l_returnflag", "l_linestatus"])
    return cube.refresh(Between("l_quantity", 10.0, 25.0, include_hi=False))


# -- display text ----------------------------------------------------------


@query(
    "pct_label",
    "with g as (" + checks.value_counts_compare("events", "props", "event_type = 'click'") + """)
select "key", case when fraction >= 0.1 then printf('%.0f%%', round(fraction * 100, 0))
                   when fraction >= 0.01 then printf('%.1f%%', round(fraction * 100, 1))
                   else printf('%.2f%%', round(fraction * 100, 2)) end as label from g
""",
)
def pct_label(spark, folder):
    s = session(spark, folder, "events").where_value("event_type", "click")
    shares = s.value_counts_compare("props")
    return shares.select("key", percent_text(F.col("fraction")).alias("label"))


@query(
    "pct_label_small",
    """
with g as (select n_nationkey, s.n * 1E0 / t.n fraction from nation
           join (select c_nationkey, count(*) n from customer group by 1) s on c_nationkey = n_nationkey,
           (select count(*) * 7 n from customer) t)
select n_nationkey, case when fraction >= 0.1 then printf('%.0f%%', round(fraction * 100, 0))
                         when fraction >= 0.01 then printf('%.1f%%', round(fraction * 100, 1))
                         else printf('%.2f%%', round(fraction * 100, 2)) end as label from g
""",
)
def pct_label_small(spark, folder):
    by = session(spark, folder, "customer").base.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = session(spark, folder, "customer").base.count() * 7
    return by.select(
        F.col("c_nationkey").alias("n_nationkey"),
        percent_text(F.col("n") / F.lit(total)).alias("label"),
    )


def _sql_number(x: str) -> str:
    return f"case when {x} = 0 then '0' else regexp_replace(format('{{:,.3f}}', {x}), '\\.?0+$', '') end"


@query(
    "fmt_numbers",
    f"select l_orderkey as id, l_linenumber as line, format('{{:,}}', l_orderkey * 1000) as big, "
    f"{_sql_number('l_extendedprice')} as price, {_sql_number('-l_discount * 1000')} as neg, "
    "l_partkey as p from lineitem",
)
def fmt_numbers(spark, folder):
    s = session(
        spark, folder, "lineitem", "l_orderkey AS id", "l_linenumber AS line",
        "l_orderkey * 1000 AS big", "l_extendedprice AS price", "-l_discount * 1000 AS neg",
        "l_partkey AS p",
    )
    fields = {f.name: f.dataType for f in s.base.schema.fields}
    return s.base.select(
        "id", "line",
        *[value_text(F.col(c), fields[c]).alias(c) for c in ("big", "price", "neg")],
        "p",
    )


@query(
    "fmt_preview",
    """
select format('{:,}', event_id) as event_id,
       replace(cast(ts as varchar), ' ', 'T') as ts,
       format('{:,}', user_id) as user_id,
       coalesce(nullif(event_type, 'click'), 'null') as event_type,
       regexp_replace(format('{:,.3f}', "value"), '\\.?0+$', '') as "value",
       cast("value" > 50 as varchar) as high,
       cast(cast(ts as date) as varchar) as "day"
from events
""",
)
def fmt_preview(spark, folder):
    s = session(
        spark, folder, "events", "event_id", "ts", "user_id",
        "nullif(event_type, 'click') AS event_type", "value", "value > 50 AS high",
        "CAST(ts AS DATE) AS day",
    )
    return preview(s.base)


@query(
    "fmt_list",
    """
select format('{:,}', vec_id) as vec_id,
       '[' || array_to_string(
         [case when x <> 0 and abs(x) < 1e-4  -- written out, not as a power, down to 1e-6
               then rtrim(cast(cast(cast(cast(x as double) as varchar) as decimal(38,30)) as varchar), '0')
               else regexp_replace(cast(cast(x as double) as varchar), '\\.0$', '') end
          for x in embedding[1:5]], ', ')
           || case when len(embedding) > 5 then ', ...' else '' end || ']' as embedding,
       '[' || "label" || ', ' || vec_id || ']' as short
from embeddings
""",
)
def fmt_list(spark, folder):
    s = session(
        spark, folder, "embeddings", "vec_id", "embedding", "array(label, vec_id) AS short"
    )
    return preview(s.base)


@query(
    "fmt_nested",
    """
select '{"a":' || p_size || ',"b":"' || p_type || '"}' as st,
       '{"' || p_type || '":' || p_size || '}' as m from part
""",
)
def fmt_nested(spark, folder):
    s = session(
        spark, folder, "part", "named_struct('a', p_size, 'b', p_type) AS st",
        "map(p_type, p_size) AS m",
    )
    return preview(s.base)


@query(
    "fmt_binary",
    """
with h as (select hex(encode("text")) h, octet_length(encode("text")) n from benchmark)
select 'b''' || array_to_string(
         [case when cast('0x' || h[2*i-1:2*i] as int) between 32 and 126
               then chr(cast('0x' || h[2*i-1:2*i] as int))
               else '\\x' || lower(h[2*i-1:2*i]) end
          for i in range(1, 1 + least(n, 32))], '')
       || case when n > 32 then '...' else '' end || '''' as b
from h
""",
)
def fmt_binary(spark, folder):
    return preview(session(spark, folder, "benchmark", "CAST(text AS BINARY) AS b").base)


@query(
    "fmt_time",
    """
with u as (select event_id, epoch_us(ts) us from events)
select event_id,
       strftime(make_timestamp(us), '%H:%M:%S')
         || rtrim(rtrim('.' || lpad(cast(us % 1000000 as varchar), 6, '0'), '0'), '.') as at_us,
       strftime(make_timestamp(us), '%H:%M:%S') as at_s,
       'PT' || (us // 1000000)
         || rtrim(rtrim('.' || lpad(cast(us % 1000000 as varchar), 6, '0'), '0'), '.') || 'S' as lasted
from u
""",
)
def fmt_time(spark, folder):
    s = session(
        spark, folder, "events", "event_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS us",
    )
    us = F.col("us")
    return s.base.select(
        "event_id",
        time_text(us, "us").alias("at_us"),
        time_text(F.floor(us / 1_000_000), "s").alias("at_s"),
        duration_text(us, "us").alias("lasted"),
    )


# -- sources and sinks -----------------------------------------------------


def _round_trip(spark: SparkSession, folder: str, table: str, fmt: str, **options) -> DataFrame:
    """Write a table as text files, open them again as a source, give all rows."""
    path = scratch_path(spark, f"{table}-{fmt}") + f".{fmt}"
    sinks.write(spark.read.parquet(f"{folder}/{table}.parquet"), path, fmt)
    return Session.of_file(spark, path, table=f"view_{table}_{fmt}", keep=False, **options).data()


@query(
    "csv_roundtrip",  # inferred types: the keys are small, so they are read as int
    "select * replace (cast(p_partkey as int) as p_partkey) from part",
)
def csv_roundtrip(spark, folder):
    return _round_trip(spark, folder, "part", "csv")


@query(
    "csv_roundtrip_multiline",
    "select * replace (cast(conv_id as int) as conv_id, cast(turn as int) as turn) from conversations",
)
def csv_roundtrip_multiline(spark, folder):
    return _round_trip(spark, folder, "conversations", "csv", multiline=True)


@query("tsv_roundtrip", "select * from customer")
def tsv_roundtrip(spark, folder):
    schema = spark.read.parquet(f"{folder}/customer.parquet").schema
    return _round_trip(spark, folder, "customer", "tsv", schema=schema)


@query("json_roundtrip", "select * from documents")
def json_roundtrip(spark, folder):
    return _round_trip(spark, folder, "documents", "json")


@query("parquet_override", "select * from supplier")
def parquet_override(spark, folder):
    path = scratch_path(spark, "supplier") + ".dat"
    sinks.write(spark.read.parquet(f"{folder}/supplier.parquet"), path)
    return Session.of_file(spark, path, fmt="parquet", table="view_override").data()


@query("catalog_table", checks.value_counts("orders", "o_orderpriority", "o_orderstatus = 'O'"))
def catalog_table(spark, folder):
    register(spark.read.parquet(f"{folder}/orders.parquet"), "orders_by_name")
    s = Session.of_table(spark, "orders_by_name").where_value("o_orderstatus", "O")
    return s.value_counts("o_orderpriority")


@query(
    "query_source",
    checks.number_histogram("(select o_custkey, count(*) n from orders group by 1)", "n"),
)
def query_source(spark, folder):
    register(spark.read.parquet(f"{folder}/orders.parquet"), "orders_for_query")
    s = Session.of_query(spark, "SELECT o_custkey, count(*) AS n FROM orders_for_query GROUP BY 1")
    return s.histogram("n")


@query("json_lines", "select p_partkey, p_name, nullif(p_size, 7) as size from part")
def json_lines(spark, folder):
    s = session(spark, folder, "part", "p_partkey", "p_name", "nullif(p_size, 7) AS size")
    parsed = F.from_json("record", s.base.schema)
    return sinks.json_lines(s.base).select(parsed.alias("r")).select("r.*")


@query("csv_no_header", "select n_nationkey as _c0, n_name as _c1, n_regionkey as _c2 from nation")
def csv_no_header(spark, folder):
    path = scratch_path(spark, "nation") + ".txt"
    spark.read.parquet(f"{folder}/nation.parquet").write.csv(path, header=False, sep="|")
    return Session.of_file(spark, path, "csv", keep=False, header=False, sep="|").data()


@query("kept_text", "select * replace (cast(s_suppkey as int) as s_suppkey) from supplier where s_acctbal > 0")
def kept_text(spark, folder):
    """A text table parsed once and kept on the executors."""
    path = scratch_path(spark, "supplier") + ".csv"
    sinks.write(spark.read.parquet(f"{folder}/supplier.parquet"), path, "csv")
    s = Session.of_file(spark, path)
    return s.where_range("s_acctbal", 1e-9, 1e9).data()


def _mixed_json(spark: SparkSession, folder: str) -> Session:
    """A folder with files of JSON lines and one whose records are in an array."""
    path = scratch_path(spark, "nation") + ".json"
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    array = nation.where("n_regionkey < 2").selectExpr("to_json(collect_list(struct(*))) AS value")
    array.write.text(path)
    nation.where("n_regionkey >= 2").write.mode("append").json(path)
    return Session.of_file(spark, path, keep=False).where_range("n_nationkey", 3, 20)


@query("json_mixed_folder", "select * replace (cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey) from nation where n_nationkey between 3 and 20")
def json_mixed_folder(spark, folder):
    return _mixed_json(spark, folder).data()


def _run_all(spark: SparkSession, text: str) -> DataFrame:
    """The result of the last of several statements."""
    *views, last = text.split(";\n")
    for view in views:
        spark.sql(view)
    return spark.sql(last)


@query("sql_export_mixed", "select * replace (cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey) from nation where n_nationkey between 3 and 20")
def sql_export_mixed(spark, folder):
    return _run_all(spark, _mixed_json(spark, folder).export_sql())


@query("sql_export_schema", "select cast(n_nationkey as varchar) as a, n_name as b, n_regionkey::double as c from nation where n_name <> 'x'")
def sql_export_schema(spark, folder):
    path = scratch_path(spark, "nation") + ".csv"
    spark.read.parquet(f"{folder}/nation.parquet").write.csv(path, header=False)
    s = Session.of_file(spark, path, schema="a STRING, b STRING, c DOUBLE", keep=False, header=False)
    return _run_all(spark, s.export_sql())


@query("sql_two_sessions", "select r_name as name from region union all select n_name from nation where n_regionkey = 1")
def sql_two_sessions(spark, folder):
    """Each session's SQL gives its own rows, also where neither was named."""
    regions = Session.of(spark, spark.read.parquet(f"{folder}/region.parquet"))
    nations = Session.of(spark, spark.read.parquet(f"{folder}/nation.parquet")).where_value("n_regionkey", "1")
    return spark.sql(regions.sql()).selectExpr("r_name AS name").union(spark.sql(nations.sql()).select("n_name"))


@query("arrow_folder", "select * from orders")
def arrow_folder(spark, folder):
    """Arrow files written by the executors, decoded by record batch."""
    path = scratch_path(spark, "orders-arrow")
    sinks.write(spark.read.parquet(f"{folder}/orders.parquet").repartition(3), path, "arrow")
    return Session.of_file(spark, f"{path}/data", fmt="arrow").data()


@query("arrow_result", "select l_orderkey, l_shipdate, l_extendedprice, l_comment_ from (select *, l_returnflag || '-' || l_linestatus l_comment_ from lineitem) where l_returnflag = 'A'")
def arrow_result(spark, folder):
    s = session(spark, folder, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag", "concat(l_returnflag, '-', l_linestatus) AS l_comment_")
    path = scratch_path(spark, "lineitem-arrow")
    sinks.write(s.where_value("l_returnflag", "A").data(), path, "arrow")
    return sinks.read_arrow_result(spark, path).drop("l_returnflag")


@query("url_parquet", checks.value_counts("part", "p_brand", "p_size between 1 and 20"))
def url_parquet(spark, folder):
    url = folder if "://" in folder else f"file://{folder}"
    s = Session.of_file(spark, f"{url}/part.parquet").where_range("p_size", 1, 20)
    return s.value_counts("p_brand")


@query("saved_table", checks.value_counts("customer", "c_mktsegment", "c_nationkey between 3 and 9"))
def saved_table(spark, folder):
    """A result saved in the catalog, and profiled from there."""
    sinks.save_table(session(spark, folder, "customer").data(), "tallyscope_saved_customers")
    s = Session.of_table(spark, "tallyscope_saved_customers").where_range("c_nationkey", 3, 9)
    return s.value_counts("c_mktsegment")


@query("column_names_part", "select column_name as name from (describe select * from part)")
def column_names_part(spark, folder):
    register(spark.read.parquet(f"{folder}/part.parquet"), "part_by_name")
    return spark.createDataFrame([(c,) for c in column_names(spark, "part_by_name")], "name string")


@query(
    "page_ends",
    "select cast(floor(i / 400) * 400 as bigint) as first_row, count(*) as n_rows, max(i) = max(m) as last_page, min(c_custkey) as low "
    "from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) - 1 as i, count(*) over () - 1 as m from customer) group by 1",
)
def page_ends(spark, folder):
    """Where each page of the whole view begins, and which is the last."""
    s = session(spark, folder, "customer").sort("c_acctbal", "desc")
    return s.page_ends(400, F.min("c_custkey").alias("low"))


@query(
    "rows_after_seek_nested",
    "select o_orderkey, o_orderstatus, 'k' || o_custkey % 3 as k from orders order by o_custkey % 5 desc, o_custkey % 2 desc, "
    "o_orderpriority, o_orderkey, '{\"k\":' || o_custkey % 3 || '}' limit 100 offset 300",
)
def rows_after_seek_nested(spark, folder):
    """The page after a row, in the order of an array, a struct and a map."""
    s = session(
        spark, folder, "orders", "array(o_custkey % 5, o_custkey % 2) AS a", "named_struct('p', o_orderpriority, 'k', o_orderkey) AS st",
        "map('k', o_custkey % 3) AS m", "o_orderkey", "o_orderstatus",
    ).sort("a", "desc").sort("st", "asc")
    last = s.page(2).tail(1)[0]
    return s.page_after(last).selectExpr("o_orderkey", "o_orderstatus", "concat('k', m['k']) AS k")


@query(
    "fmt_list_timestamp",
    "select format('{:,}', event_id) as event_id, "
    "'[' || replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', ''), ' ', 'T') || ', ' || event_type || ']' as l, "
    "'{\"t\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%f')[1:3] || 'Z\"}' as s from events "
    "where strftime(ts, '%S%f') not like '%0'",
)
def fmt_list_timestamp(spark, folder):
    """Instants inside lists and structs, shown in UTC."""
    at = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"
    s = session(spark, folder, "events", "event_id", f"array({at}) AS l", "event_type", f"named_struct('t', {at}) AS s", "ts")
    rows = s.base.where("date_format(ts, 'ssSSSSSS') NOT LIKE '%0'")
    shown = preview(rows.select("event_id", "l", "event_type", "s"))
    return shown.selectExpr("event_id", "concat(rtrim(']', l), ', ', event_type, ']') AS l", "s")
