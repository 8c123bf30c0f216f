"""Views that give the test tables the shapes of canopy data.

The same SQL text runs in Spark and in the oracle, so both see equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_units": """SELECT n_nationkey AS unit_ord, CAST(n_nationkey AS STRING) AS geoid, n_regionkey AS city,
        20.0E0*(n_nationkey % 5) AS x0, 20.0E0*(n_nationkey % 5)+20.0E0 AS x1,
        20.0E0*floor(n_nationkey/5) AS y0, 20.0E0*floor(n_nationkey/5)+20.0E0 AS y1 FROM nation""",
    "fx_trees": """SELECT o_orderkey AS tree_id, c_nationkey AS unit_ord,
        (o_orderkey*7919 % 10007)/10007.0E0*100.0E0 AS x, (o_orderkey*6101 % 10009)/10009.0E0*100.0E0 AS y,
        1+CAST(floor(o_totalprice/5000.0E0) AS BIGINT) AS crown_area_px
        FROM orders JOIN customer ON o_custkey=c_custkey""",
    "fx_trees_edge": """SELECT o_orderkey AS tree_id, (o_orderkey*7919 % 201)/2.0E0 AS x,
        (o_orderkey*6101 % 201)/2.0E0 AS y FROM orders""",
    "fx_income": """SELECT c_nationkey AS unit_ord, CASE WHEN c_nationkey % 7 = 3 THEN NULL
        ELSE CAST(sum(CAST(round(c_acctbal*100.0E0) AS BIGINT)) AS BIGINT)/(count(*)*10.0E0) END AS median_income
        FROM customer GROUP BY c_nationkey""",
    "fx_inventory": """SELECT event_id AS inv_id, user_id % 20 AS unit_ord, (event_id*4241 % 9973)/9973.0E0*100.0E0 AS x,
        (event_id*3571 % 9967)/9967.0E0*80.0E0 AS y FROM events""",
    # Even tiles are PAN and odd ones NDVI.  Of ten, three pairs share their base name, one pair only the
    # tail of it, and in one pair the PAN tile has a tail that no NDVI tile has.
    "fx_tiles": """SELECT s_suppkey AS tile_ord,
        concat(CASE WHEN s_suppkey % 2=0 THEN 'pred_pan_' ELSE 'pred_ndvi_' END,
               CAST(((s_suppkey - s_suppkey % 2)*5000 + CASE WHEN s_suppkey % 10 >= 8 THEN s_suppkey % 2*2500 ELSE 0 END) % 35000 AS STRING),'-',
               CAST(((s_suppkey - s_suppkey % 2)*15000) % 40000 AS STRING),
               '_austin_036_',CAST(100 + CASE WHEN s_suppkey % 10=4 THEN 50 + s_suppkey % 50 ELSE (s_suppkey - s_suppkey % 2) % 50 END AS STRING),'.tif') AS filename,
        (s_suppkey*37 % 96)*1.0E0 AS x0, (s_suppkey*53 % 96)*1.0E0 AS y0,
        (s_suppkey*37 % 96)+6.0E0 AS x1, (s_suppkey*53 % 96)+6.0E0 AS y1 FROM supplier""",
    "fx_detections": """SELECT l_suppkey AS tile_ord, l_orderkey*10+l_linenumber AS label, l_partkey AS pk,
        (l_partkey*37 % 1000)/10.0E0 AS x, (l_orderkey*53 % 1000)/10.0E0 AS y,
        CAST(l_quantity AS BIGINT) AS crown_area_px FROM lineitem""",
    "fx_bounds": """SELECT r_regionkey AS city, 12.5E0*r_regionkey AS ox, 7.5E0*r_regionkey AS oy FROM region""",
    "fx_parcels": """SELECT c_custkey AS parcel, (c_custkey*7919 % 9973)/9973.0E0*95.0E0 AS px,
        (c_custkey*6101 % 9967)/9967.0E0*95.0E0 AS py FROM customer""",
    "fx_pixels": """SELECT l_suppkey % 8 AS tile_ord, l_partkey % 64 AS r, l_orderkey % 64 AS c,
        CAST(max(l_quantity) AS DOUBLE)/50.0E0 AS v FROM lineitem WHERE l_discount < 0.03E0 GROUP BY 1,2,3""",
    # Tiles of 256 pixels, with discs in slots of 16 that never touch, some without a quarter, some a line, all in a
    # faint halo.  Every fourth tile has few.
    "fx_crowns": """SELECT tile_ord, crown, rad*4+CASE WHEN crown%3=0 THEN 2 ELSE 0 END+CASE WHEN crown%7=0 THEN 1 ELSE 0 END AS kind, mr+dr AS r, mc+dc AS c,
        CASE WHEN dr*dr+dc*dc<=rad*rad AND NOT (crown%3=0 AND dr>0 AND dc>0) AND NOT (crown%7=0 AND dr<>0)
          THEN 0.31E0+((crown*31+dr*7+dc*3+100)%60)/100.0E0 ELSE 0.25E0 END AS v
        FROM (SELECT CAST((c_custkey-c_custkey%30)/30 AS BIGINT) AS tile_ord, CAST(c_custkey AS BIGINT) AS crown, CAST(1+c_custkey%6 AS BIGINT) AS rad,
            CAST((c_custkey*37)%256-((c_custkey*37)%256)%16+8 AS BIGINT) AS mr, CAST(16*(((c_custkey*37)%256)%16)+8 AS BIGINT) AS mc FROM customer) m
        JOIN (SELECT CAST(a.n_nationkey-7 AS BIGINT) AS dr, CAST(b.n_nationkey-7 AS BIGINT) AS dc FROM nation a JOIN nation b ON a.n_nationkey<15 AND b.n_nationkey<15) d
          ON dr*dr+dc*dc<=(rad+1)*(rad+1) WHERE NOT (tile_ord%4=3 AND crown%30>3)""",
    # Names of nations in forms that go down the list with the nation's number, in either case, some with a blank behind.
    "fx_places": """SELECT place, name_ AS name, CASE WHEN place%2=0 THEN 'x City' ELSE 'x CDP' END AS legal, concat(CASE WHEN place%9=0 THEN '5915' ELSE '4800' END, CAST(place AS STRING)) AS code,
        place*10.0E0 AS x0, 0.0E0 AS y0, place*10.0E0+1.0E0+place%8 AS x1, 0.5E0 AS y1, (1.0E0+place%8)*0.5E0 AS area
        FROM (SELECT place, concat(CASE WHEN place%3=0 THEN upper(form) ELSE form END, CASE WHEN place%4=0 THEN ' ' ELSE '' END) AS name_
          FROM (SELECT CAST(c_custkey AS BIGINT) AS place, CASE WHEN v<n%7 OR v=5 THEN concat('Hamlet ',CAST(c_custkey AS STRING)) WHEN v=0 THEN own WHEN v=1 THEN concat(own,' city') WHEN v=2 THEN concat('City of ',own)
              WHEN v=3 THEN concat(own,' town') WHEN v=4 THEN concat('Town of ',own) ELSE concat('Greater ',own,' area') END AS form
            FROM (SELECT c_custkey, c_custkey%25 AS n, ((c_custkey-c_custkey%25)/25)%8 AS v, concat('Nation_',CAST(c_custkey%25 AS STRING)) AS own FROM customer) c1) c2) c3""",
    # Cutouts with offsets or a patch number, one in six of no known city, one in eight without a whole tile id.
    "fx_cutouts": """SELECT CAST(c_custkey AS BIGINT) AS k, concat(CASE WHEN c_custkey%2=0 THEN 'pred_pan_' ELSE 'pred_ndvi_' END,
        CASE WHEN c_custkey%9=0 THEN concat('patch_',CAST(c_custkey AS STRING)) ELSE concat(CAST(c_custkey*256 AS STRING),'-',CAST(c_custkey%7*256 AS STRING)) END,
        CASE c_custkey%6 WHEN 0 THEN '_austin_' WHEN 1 THEN '_bloomington_' WHEN 2 THEN '_cupertino_' WHEN 3 THEN '_Surrey_' WHEN 4 THEN '_boston_' ELSE '_austin_' END,
        CASE WHEN c_custkey%8=7 THEN '36' ELSE concat('036_',CAST(100+c_custkey%10 AS STRING)) END,'.tif') AS filename FROM customer""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    """The named views or tables of one folder."""
    for t in BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return tuple(spark.sql(VIEWS[n]) if n in VIEWS else spark.table(n) for n in names)


def with_views(sql: str) -> str:
    """Oracle text: the views a query names, in front of it."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in sql]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(used) + ", " + body[5:]
    return "WITH " + ", ".join(used) + " " + body
