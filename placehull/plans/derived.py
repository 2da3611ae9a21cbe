"""Places, responses and logs derived from the TPC-H-like test tables.

The texts below run in Spark and in DuckDB, but for one expression and a type's name; ``ctes`` strings them together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a search result's fields, from a result r with its lineitem and its POI p, and of its item in a response.
RESULT_TEXTS = {
    "uid": """concat('u', cast(l_orderkey as varchar(20)), '_', cast(l_linenumber as varchar(20)), '_', cast(l_partkey as varchar(20)), '_', cast(l_suppkey as varchar(20)), '_', cast(r.search_rank as varchar(20)))""",
    "uid_name": """case when l_linenumber % 3 = 0 then p.name else concat(p.name, ' ', l_returnflag) end""",
    "u_lng": """cast(p.lng as decimal(10,4)) + cast(0.0125 as decimal(10,4)) + cast((l_suppkey % 21 - 10) * 25 as decimal(10,0)) * cast(0.0001 as decimal(10,4))""",
    "u_lat": """cast(p.lat as decimal(10,4)) + cast(0.0073 as decimal(10,4)) + cast((l_partkey % 21 - 10) * 20 as decimal(10,0)) * cast(0.0001 as decimal(10,4))""",
    "tag": """case when l_linenumber = 1 then null when l_linenumber = 2 then p.prim_ind
       when l_linenumber = 5 then concat(p.prim_ind, ';OTHER') when l_linenumber = 6 then concat(p.prim_ind, ';', p.sec_ind, ';X')
       else concat(p.prim_ind, ';', p.sec_ind) end""",
}
ITEM = """concat('{"name":"', uid_name, '","uid":"', uid, '","location":{"lat":', cast(u_lat as varchar(20)),
                 ',"lng":', cast(u_lng as varchar(20)), '}',
                 case when tag is null then '' else concat(',"detail_info":{"tag":"', tag, '"}') end, '}')"""

VIEWS = {
    "poi": """
select c_custkey as poi_id, c_name as name,
  116.0 + cast((c_custkey * 7919) % 8000 as double) / 10000.0 as lng,
  39.6 + cast((c_custkey * 104729) % 6000 as double) / 10000.0 as lat,
  c_mktsegment as prim_ind, n_name as sec_ind,
  case when c_custkey % 10 = 3 then 'Matched' when c_custkey % 10 = 7 then 'No Uid' else null end as prior_status
from customer join nation on c_nationkey = n_nationkey
""",
    "search_result": f"""
select r.poi_id,
  {RESULT_TEXTS['uid']} as uid,
  {RESULT_TEXTS['uid_name']} as uid_name,
  r.search_rank,
  {RESULT_TEXTS['u_lng']} as u_lng,
  {RESULT_TEXTS['u_lat']} as u_lat,
  {RESULT_TEXTS['tag']} as tag,
  cast(floor((p.lng + 0.0125) / 0.00000898305509) as bigint) + (l_suppkey % 21 - 10) * 20 as cx,
  cast(floor(4838073 + (p.lat - 39.9916) * 145300) as bigint) + (l_partkey % 21 - 10) * 20 as cy,
  100 + (l_partkey % 40) * 15 as h
from (select o_custkey as poi_id, l.*, row_number() over (partition by o_custkey
        order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as search_rank
      from orders join lineitem l on o_orderkey = l_orderkey) r
join poi p on p.poi_id = r.poi_id
""",
    "search_response": """
select p.poi_id, case when p.poi_id % 50 = 0 then 401 else 0 end as status,
  concat('{"status":', case when p.poi_id % 50 = 0 then '401' else '0' end, ',"results":[', coalesce(s.items, ''), ']}') as body
from poi p left join (
  select poi_id, ITEMS_BY_RANK as items
  from (select poi_id, search_rank,
          """ + ITEM + """ as item
        from search_result) i
  group by poi_id) s on s.poi_id = p.poi_id
""",
    "boundary_response": """
select poi_id, uid, search_rank,
  case when search_rank = 7 then '{"content":{}}' when search_rank = 8 and poi_id % 4 = 0 then '{"content":{"geo":"4|bad"}}'
  else concat('{"content":{"geo":"4|', cast(cx - h as varchar(20)), ',', cast(cy - h as varchar(20)), ';', cast(cx + h as varchar(20)), ',', cast(cy + h as varchar(20)), '|1-',
   cast(cx - h as varchar(20)), ',', cast(cy - h as varchar(20)), ',', cast(cx + h as varchar(20)), ',', cast(cy - h as varchar(20)), ',',
   cast(cx + h + 30 as varchar(20)), ',', cast(cy as varchar(20)), ',',
   cast(cx + h as varchar(20)), ',', cast(cy + h as varchar(20)), ',', cast(cx - h as varchar(20)), ',', cast(cy + h as varchar(20)), ',',
   cast(cx - h as varchar(20)), ',', cast(cy - h as varchar(20)), ';","uid":"', uid, '"}}') end as body
from search_result where not (search_rank = 9 and poi_id % 6 = 0)
""",
    "fetch_log": """
select user_id as request_id, event_id, ts,
  case when event_type = 'error' then 503 when event_id % 11 = 0 then 403 when event_id % 13 = 0 then 404 else 200 end as http_status
from events
""",
    "boundary_request": """
select poi_id, uid, search_rank, (poi_id * 31 + search_rank * 7) % 150 as request_id,
  cast(date '2024-01-01' + cast((poi_id * 17 + search_rank) % 25 as int) as NTZ) as issued_ts
from search_result
""",
}
#: The only texts that differ: a list of any length in search order.
NTZ = {"duckdb": "timestamp", "spark": "timestamp_ntz"}
ITEMS_BY_RANK = {
    "duckdb": "string_agg(item, ',' order by search_rank)",
    "spark": "array_join(transform(array_sort(collect_list(struct(search_rank, item))), x -> x.item), ',')",
}
NEEDS = {
    "poi": (),
    "search_result": ("poi",),
    "search_response": ("poi", "search_result"),
    "boundary_response": ("poi", "search_result"),
    "fetch_log": (),
    "boundary_request": ("poi", "search_result"),
}
BASE_TABLES = ("nation", "customer", "orders", "lineitem", "events")


def cte(name: str, engine: str = "duckdb") -> str:
    """``name as (...)`` of one view."""
    text = VIEWS[name].strip().replace("ITEMS_BY_RANK", ITEMS_BY_RANK[engine])
    return f"{name} as ({text.replace('as NTZ', f'as {NTZ[engine]}')})"


def ctes(*views: str, engine: str = "duckdb") -> str:
    """``name as (...)`` items for the views and what they need, in dependency order."""
    wanted = {v for view in views for v in (*NEEDS[view], view)}
    return ",\n".join(cte(v, engine) for v in VIEWS if v in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the parquet tables in ``sf_dir``."""
    tables = ",\n".join(
        f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)"
        for t in BASE_TABLES
        if t in _base_tables(name)
    )
    return spark.sql(f"with {tables},\n{ctes(name, engine='spark')}\nselect * from {name}")


GROUPS = """
select g.poi_id, g.ps, transform(l.ls, x -> struct(x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, x.l_returnflag)) as ls
from (select poi_id, collect_list(struct(name, lng, lat, prim_ind, sec_ind)) as ps from poi group by poi_id) g
left join (
  select o_custkey, array_sort(collect_list(struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag))) as ls
  from orders join lineitem on o_orderkey = l_orderkey where o_custkey is not null group by o_custkey) l on l.o_custkey = g.poi_id
"""
RESULTS = """
select poi_id, p, pos + 1 as search_rank, l.*
from ROWS lateral view explode(ps) a as p lateral view posexplode(ls) b as pos, l
"""


def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per poi_id: its POI rows and its search results' keys in search order; the views on results are made of it.

    So the tables are joined and grouped once for all of them, and no text is shuffled.
    """
    tables = ",\n".join(f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in ("nation", "customer", "orders", "lineitem"))
    return spark.sql(f"with {tables},\n{cte('poi', 'spark')}\n{GROUPS}")


def _over(rows: DataFrame, text: str) -> DataFrame:
    """``text`` over ``rows``, which it calls ROWS."""
    text = text.replace("{", "{{").replace("}", "}}").replace("ROWS", "{rows}")
    return rows.sparkSession.sql(text, rows=rows)


def from_groups(groups: DataFrame, name: str, by_uid: int = 0) -> DataFrame:
    """The view ``name`` on search results, row by row from ``search_groups``.

    ``by_uid``: its results are dealt out to so many partitions by uid, as keys before their texts are made (not for search responses).
    """
    if name == "search_response":
        # the fields of a result from the array elements p and l, then its item from these fields
        texts = {f: re.sub(r"\bl_(\w+)", r"l.l_\1", t).replace("r.search_rank", "(i + 1)") for f, t in RESULT_TEXTS.items()}
        fields = ", ".join(f"{t} as {f}" for f, t in texts.items())
        item = re.sub(r"(?<![\"'])\b(uid_name|uid|u_lat|u_lng|tag)\b(?![\"'])", r"x.\1", ITEM)
        rows = _over(groups, f"""select poi_id, ps, flatten(transform(ps, p -> transform(ls, (l, i) -> struct(i + 1 as search_rank, {fields})))) as found from ROWS""")
        rows = _over(rows, f"select poi_id, ps, transform(found, x -> struct(x.search_rank, {item} as item)) as items from ROWS")
        # several POI rows of one id have their results merged by rank
        merged = "array_join(transform(case when size(ps) > 1 then array_sort(items) else items end, x -> x.item), ',')"
        rows = _over(rows, f"select poi_id, {merged} as items, explode(ps) as p from ROWS")
        return _over(rows, VIEWS[name].split("from poi p left join")[0].replace("p.poi_id", "s.poi_id") + " from ROWS s")
    fields = VIEWS["search_result"].split("from (select o_custkey")[0]
    rows = _over(groups, RESULTS)
    if by_uid:
        rows = rows.repartition(by_uid, F.expr(RESULT_TEXTS["uid"].replace("r.search_rank", "search_rank")))
    results = _over(rows, f"{fields} from ROWS r")
    if name == "search_result":
        return results
    return _over(results, VIEWS[name].replace("as NTZ", f"as {NTZ['spark']}").replace("from search_result", "from ROWS"))


def _base_tables(name: str) -> set[str]:
    if name == "fetch_log":
        return {"events"}
    if name == "poi":
        return {"nation", "customer"}
    return {"nation", "customer", "orders", "lineitem"}
