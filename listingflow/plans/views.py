"""Listings, leads and calls derived from the generic test tables.

The statements run unchanged on DuckDB, and on Spark but for ON_SPARK, so queries
and their SQL see the same rows.
"""

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "timestamp '2024-01-31 00:00:00'"
TABLES = ("customer", "orders", "documents", "events", "pages")
VIEWS = {
    "v_contacts": """
SELECT c_custkey + 1 AS id,
       '+48' || CAST(500000000 + c_custkey AS STRING) AS phone_e164,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
       c_custkey % 17 = 0 AS do_not_call,
       TIMESTAMP '2023-12-01 00:00:00' AS created_at
  FROM customer
""",
    "v_listings": """
SELECT o.o_orderkey + 1 AS id,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'olx' WHEN 1 THEN 'otodom' ELSE 'gratka' END AS source,
       CAST(o.o_orderkey AS STRING) AS source_id,
       'https://example.test/' || CAST(o.o_orderkey AS STRING) AS url,
       CASE WHEN o.o_custkey % 4 = 0 THEN 'rent' ELSE 'sale' END AS deal_type,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            WHEN o.o_custkey % 3 = 0 THEN 'Gdańsk' WHEN o.o_custkey % 3 = 1 THEN 'Sopot' ELSE 'Gdynia' END AS city,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE 'District ' || CAST(o.o_orderkey % 12 AS STRING) END AS district,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'Street ' || CAST(o.o_custkey % 200 AS STRING) END AS street,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
            ELSE CAST(300000 + (o.o_custkey % 97) * 5000 + (o.o_orderkey % 4) * 4000 AS BIGINT) END AS price,
       CAST(300 + (o.o_custkey % 50) * 10 + (o.o_orderkey % 5) * 4 AS DOUBLE) / 10 AS area_m2,
       CAST(CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE 1 + o.o_custkey % 5 END AS INT) AS rooms,
       CAST(CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE o.o_orderkey % 11 END AS INT) AS floor,
       'Flat ' || CAST(o.o_orderkey AS STRING) AS title,
       CASE WHEN o.o_orderkey < o.nd THEN d.text ELSE NULL END AS description,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL
            ELSE '+48' || CAST(500000000 + o.o_custkey AS STRING) END AS phone_e164,
       CASE o.o_orderstatus WHEN 'F' THEN 'agency' WHEN 'O' THEN 'private' ELSE 'unknown' END AS seller_type,
       CASE o.o_orderstatus WHEN 'F' THEN 'firma' WHEN 'O' THEN 'osoba prywatna' ELSE NULL END AS seller_label,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'g' || CAST(o.o_custkey AS STRING) ELSE NULL END AS dedup_group,
       e.ts AS first_seen_at,
       e.ts AS last_seen_at,
       o.o_orderkey % 13 <> 0 AS is_active
  FROM (SELECT orders.*, nd, o_orderkey % nd AS doc_key, o_orderkey % ne AS event_key
          FROM orders CROSS JOIN (SELECT COUNT(*) AS nd FROM documents) a
                      CROSS JOIN (SELECT COUNT(*) AS ne FROM events) b) o
  JOIN documents d ON d.doc_id = o.doc_key
  JOIN events e ON e.event_id = o.event_key
""",
    "v_raw_listings": """
SELECT id, source, source_id, url, deal_type, title, description,
       CASE WHEN price IS NULL THEN 'Zapytaj o cenę'
            WHEN id % 3 = 0 THEN CAST(price AS STRING)
            WHEN id % 3 = 1 THEN CAST(CAST(FLOOR(price / 1000) AS BIGINT) AS STRING) || ' ' || LPAD(CAST(price % 1000 AS STRING), 3, '0') || ' zł'
            ELSE CAST(CAST(FLOOR(price / 1000) AS BIGINT) AS STRING) || '.' || LPAD(CAST(price % 1000 AS STRING), 3, '0') END AS price_raw,
       CAST(CAST(FLOOR(area_m2) AS BIGINT) AS STRING) || ',' || CAST(CAST(ROUND(area_m2 * 10) AS BIGINT) % 10 AS STRING) || ' m²' AS area_raw,
       CASE WHEN rooms IS NULL THEN NULL WHEN rooms = 1 THEN 'Kawalerka' ELSE CAST(rooms AS STRING) || ' pokoje' END AS rooms_raw,
       CASE WHEN floor IS NULL THEN NULL WHEN floor = 0 THEN 'parter' ELSE CAST(floor AS STRING) || ' piętro' END AS floor_raw,
       COALESCE(city, 'Warszawa') || COALESCE(', ' || district, '') || COALESCE(', ul. ' || street, '') || ', Pomorskie' AS location_raw,
       CASE WHEN phone_e164 IS NULL THEN NULL
            WHEN id % 2 = 0 THEN 'tel. ' || SUBSTRING(phone_e164, 4, 3) || ' ' || SUBSTRING(phone_e164, 7, 3) || '-' || SUBSTRING(phone_e164, 10, 3)
            ELSE '00' || SUBSTRING(phone_e164, 2, 11) END AS phone_raw,
       seller_label, first_seen_at AS seen_at
  FROM v_listings
""",
    "v_leads": """
SELECT l.id AS id, o.o_custkey + 1 AS contact_id, l.id AS listing_id,
       CASE l.id % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'called_no_answer' WHEN 2 THEN 'talked' WHEN 3 THEN 'callback'
                     WHEN 4 THEN 'meeting' WHEN 5 THEN 'contract' WHEN 6 THEN 'lost' ELSE 'dnc' END AS status,
       CASE WHEN l.id % 8 = 3 THEN 'oddzwonić' ELSE NULL END AS next_step,
       CASE WHEN l.id % 8 = 3 OR l.id % 10 = 0 THEN l.first_seen_at + INTERVAL '15' DAY ELSE NULL END AS next_step_at,
       CASE WHEN l.id % 8 = 6 THEN 'price' ELSE NULL END AS lost_reason,
       l.first_seen_at AS created_at,
       l.first_seen_at AS updated_at
  FROM v_listings l JOIN orders o ON o.o_orderkey + 1 = l.id
 WHERE l.id % 5 <> 1
""",
    "v_call_log": """
SELECT event_id + 1 AS id, (event_id * 7) % n + 1 AS lead_id, ts AS called_at,
       CASE event_type WHEN 'view' THEN 'no_answer' WHEN 'click' THEN 'talked' WHEN 'error' THEN 'refused'
                       WHEN 'purchase' THEN 'callback' ELSE 'meeting' END AS outcome,
       CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE NULL END AS opener_used,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'price' ELSE NULL END AS objection
  FROM events CROSS JOIN (SELECT COUNT(*) AS n FROM orders) c
""",
    "v_meetings": """
SELECT m.id, m.lead_id, m.called_at + INTERVAL '3' DAY AS starts_at,
       'Street ' || CAST(m.id % 50 AS STRING) AS address, CAST(NULL AS STRING) AS note,
       CASE m.id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'thinking' WHEN 2 THEN 'failed' ELSE NULL END AS outcome
  FROM v_call_log m JOIN v_leads l ON l.id = m.lead_id
 WHERE m.outcome = 'meeting'
""",
    "v_scan_log": """
SELECT event_id + 1 AS id,
       CASE user_id % 3 WHEN 0 THEN 'olx' WHEN 1 THEN 'otodom' ELSE 'gratka' END AS source,
       ts AS started_at,
       CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'ok' END AS status,
       CAST(CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 50 END AS INT) AS found
  FROM events
""",
    "v_lead_events": """
SELECT event_id + 1 AS seq, (event_id * 7) % n + 1 AS lead_id, ts AS at,
       CASE WHEN event_id % 10 < 6 THEN 'call' WHEN event_id % 10 < 8 THEN 'status'
            WHEN event_id % 10 = 8 THEN 'meeting_booked' ELSE 'do_not_call' END AS kind,
       CASE event_type WHEN 'view' THEN 'no_answer' WHEN 'click' THEN 'talked' WHEN 'error' THEN 'refused'
                       WHEN 'purchase' THEN 'callback' ELSE 'meeting' END AS outcome,
       CASE event_id % 3 WHEN 0 THEN 'talked' WHEN 1 THEN 'callback' ELSE 'lost' END AS status,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'price' END AS reason,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'note ' || CAST(event_id % 5 AS STRING) END AS note,
       CASE WHEN event_id % 10 = 8 THEN 'Street ' || CAST(event_id % 50 AS STRING) END AS address,
       ts + INTERVAL '5' DAY AS next_step_at
  FROM events CROSS JOIN (SELECT COUNT(*) AS n FROM orders) c
""",
    "v_meeting_closes": """
SELECT 2 * m.id + k AS seq, m.id AS meeting_id, m.lead_id, m.starts_at AS at, 'meeting_closed' AS kind,
       CASE (m.id + k) % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'thinking' ELSE 'failed' END AS outcome,
       'note ' || CAST(m.id % 7 + k AS STRING) AS note
  FROM v_meetings m CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t
 WHERE m.id % 3 >= k
""",
}

#: What of v_listings only Spark's form says another way.
_TEXT, _JOINED = "CASE WHEN o.o_orderkey < o.nd THEN d.text ELSE NULL END", re.compile(r"  (JOIN documents .*)\n  (JOIN events .*)\n")


def _parted(sql: str) -> str:
    """v_listings in two parts: listings with a text, and the others, which meet the
    documents by doc_id alone. Texts then move once for each document and not once
    for each listing, and are dealt out evenly whatever files their orders are in.
    """
    narrow = _JOINED.sub(r"  \2\n  \1\n", sql)
    texts = narrow.replace("SELECT", "SELECT /*+ MERGE(d) */", 1) + " WHERE o.o_orderkey < o.nd"
    others = narrow.replace(_TEXT, "CAST(NULL AS STRING)") + " WHERE coalesce(o.o_orderkey >= o.nd, true)"
    return f"{texts} UNION ALL {others}"


#: The same rows as VIEWS, where Spark needs another plan than the plain statement.
ON_SPARK = VIEWS | {"v_listings": _parted(VIEWS["v_listings"])}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views, without registering anything in the session's catalog."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[:4]}
    found: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in found:
            sql = ON_SPARK[name]
            used = {v: get(v) for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)}
            used |= {t: df for t, df in tables.items() if re.search(rf"\b{t}\b", sql)}
            text = re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)(?=[\s),]|$)", r"{\1}", sql)
            found[name] = spark.sql(text.replace("orders.*", "{orders}.*") if "orders.*" in text else text, **used)
        return found[name]

    return [get(n) for n in names]


def with_views(sql: str) -> str:
    """sql for DuckDB with the views it names in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                add(VIEWS[v])
                need.append(v)

    add(sql)
    if not need:
        return sql
    head, rest = ("WITH RECURSIVE ", sql[len("WITH RECURSIVE ") :]) if sql.startswith("WITH RECURSIVE ") else ("WITH ", sql.removeprefix("WITH "))
    own = ", " if rest != sql else "\n"
    return head + ", ".join(f"{v} AS ({VIEWS[v]})" for v in need) + own + rest
