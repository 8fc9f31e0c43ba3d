"""News, events and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import (
    EVENTS, NEWS, UNIVERSE, contracts, events, news, table, universe,
)
from tickloom.functions import text as tx
from tickloom.operators import signals as sg
from tickloom.session import stage

_WS = "[ \\t\\n\\r\\f]+"
_CLEAN = f"trim(regexp_replace(regexp_replace({{x}}, '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g'))"
_DATE = """CASE WHEN published SIMILAR TO '[0-9]{2}-[A-Z].*' THEN strptime(published, '%d-%b-%Y')
  WHEN published SIMILAR TO '[0-9]{4}-.*' THEN strptime(published, '%Y-%m-%d')
  ELSE strptime(published[6:25], '%d %b %Y %H:%M:%S') - INTERVAL 330 MINUTE END"""
_NORM = f"""{NEWS}, nm0 AS (SELECT * REPLACE ({_CLEAN.format(x='headline')} AS headline), {_DATE} AS published_at FROM news),
nm AS (SELECT *, substr(md5(source || ':' || headline), 1, 12) AS id FROM nm0)"""


def _norm(s, d):
    return sg.normalise(news(s, d))


add("F15_news_id", _norm, "doc_id:l id", f"WITH {_NORM}\nSELECT * FROM nm")
add("F17_html_strip", lambda s, d: table(s, d, "pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("digest"), F.length(tx.strip_html(F.col("html"))).alias("n")),
    "page_id:l digest n:l",
    f"WITH c AS (SELECT page_id, {_CLEAN.format(x='html')} AS t FROM pages)\nSELECT page_id, md5(t) AS digest, length(t) AS n FROM c")
add("F18_parse_dates", lambda s, d: _norm(s, d).withColumn("sec", F.unix_timestamp("published_at")), "doc_id:l sec:l",
    f"WITH {_NORM}\nSELECT doc_id, epoch(published_at) AS sec FROM nm")
_TAGS = f"""{_NORM}, {UNIVERSE},
hit AS (SELECT nm.doc_id, symbol FROM nm, universe WHERE contains(upper(headline), symbol) UNION
  SELECT doc_id, unnest(regexp_extract_all(upper(headline), 'NSE[: \\t\\n\\r\\f]+([A-Z]{{2,10}})', 1)) FROM nm UNION
  SELECT doc_id, unnest(regexp_extract_all(upper(headline), 'BSE[: \\t\\n\\r\\f]+([A-Z]{{2,10}})', 1)) FROM nm)"""
add("F16_extract_symbols", lambda s, d: sg.extract_symbols(_norm(s, d), universe(s, d), "doc_id"), "doc_id:l symbol",
    f"WITH {_TAGS}\nSELECT * FROM hit")


def _feed(s, d):
    """Merged, tagged and cleaned news; items of src0 are stored already."""
    n = _norm(s, d)
    parts = [n.where("source = 'NSE'"), n.where("source = 'BSE'"), n.where("source NOT IN ('NSE', 'BSE')")]
    history = n.where("source = 'src0'").select("id").distinct()
    return sg.merge_feeds(parts, ["doc_id"], history)


_MRG = f"""{_TAGS}, mg AS (SELECT * FROM nm WHERE id NOT IN (SELECT id FROM nm WHERE source = 'src0') QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1)"""
add("U2_news_union", _feed, "id doc_id:l source", f"WITH {_MRG}\nSELECT * FROM mg")


def _tagged(s, d):
    return sg.tag_symbols(stage(_feed(s, d), "feed"), universe(s, d))


_MACRO = " OR ".join(f"contains(upper(headline), '{w}')" for w in tx.MACRO_WORDS)
_TG = f"""{_MRG}, rel AS (SELECT mg.* FROM mg WHERE {_MACRO} OR doc_id IN (SELECT doc_id FROM hit JOIN universe USING (symbol)))"""
add("P11_relevant_news", lambda s, d: sg.relevant(_tagged(s, d), universe(s, d)), "id doc_id:l", f"WITH {_TG}\nSELECT * FROM rel")
add("O3_priority_batch", lambda s, d: sg.priority_batch(sg.relevant(_tagged(s, d), universe(s, d))).withColumn("sec", F.unix_timestamp("published_at")),
    "id priority:l sec:l",
    f"""WITH {_TG}
SELECT id, CASE source WHEN 'NSE' THEN 0 WHEN 'BSE' THEN 1 ELSE 2 END AS priority, epoch(published_at) AS sec FROM rel WHERE NOT scored ORDER BY priority, published_at, id LIMIT 10""")
_CL = f"""cl AS (SELECT * REPLACE (least(greatest(uncertainty, 0), 1) AS uncertainty, least(greatest(sentiment, -1), 1) AS sentiment,
  least(greatest(widen_factor, 1), 5) AS widen_factor, least(greatest(pause_minutes, 0), 240) AS pause_minutes,
  CASE mm_action WHEN 'HOLD' THEN 'NORMAL' ELSE mm_action END AS mm_action) FROM mg)"""


def _clamped(s, d):
    return sg.clamp_scores(_tagged(s, d))


add("F21_clamp_scores", lambda s, d: sg.clamp_scores(_feed(s, d)), "id uncertainty:4 sentiment:4 widen_factor:4 pause_minutes:l mm_action",
    f"WITH {_MRG}, {_CL}\nSELECT * FROM cl")
add("C11_news_feed", lambda s, d: sg.relevant(_clamped(s, d), universe(s, d)).withColumn("tags", F.concat_ws(",", "symbols")),
    "id doc_id:l source scored:b uncertainty:4 widen_factor:4 mm_action tags",
    f"""WITH {_TG}, {_CL}, tg AS (SELECT doc_id, string_agg(symbol, ',' ORDER BY symbol) AS tags FROM hit GROUP BY 1)
SELECT cl.*, coalesce(tags, '') AS tags FROM cl LEFT JOIN tg USING (doc_id) WHERE id IN (SELECT id FROM rel)""")


def _links(s, d, items):
    return sg.news_by_instrument(items.withColumn("llm_symbols", F.array(F.lit("ZZQQ"))), contracts(s, d))


_LK = f"""lk AS (SELECT DISTINCT symbol || '26MAYFUT' AS contract, id FROM (SELECT mg.id, h.symbol FROM mg JOIN hit h USING (doc_id) UNION SELECT id, 'ZZQQ' FROM mg) q JOIN universe USING (symbol))"""
add("J8_news_by_instrument", lambda s, d: _links(s, d, _tagged(s, d)), "contract id", f"WITH {_MRG}, {_LK}\nSELECT * FROM lk")
add("P12_items_per_instrument",
    lambda s, d: _links(s, d, _tagged(s, d)).groupBy("contract").agg(F.count(F.lit(1)).alias("n_items"), F.min("id").alias("first_id")),
    "contract n_items:l first_id", f"WITH {_MRG}, {_LK}\nSELECT contract, count(*) AS n_items, min(id) AS first_id FROM lk GROUP BY 1")
add("A39_news_actions", lambda s, d: sg.news_actions(_clamped(s, d)), "symbol worst_action max_factor:4 n_items:l",
    f"""WITH {_MRG}, {_CL}, x AS (SELECT symbol, mm_action, widen_factor FROM cl JOIN hit USING (doc_id) WHERE scored AND mm_action <> 'NORMAL')
SELECT symbol, arg_max(mm_action, CASE mm_action WHEN 'PAUSE' THEN 2 ELSE 1 END) AS worst_action, max(widen_factor) AS max_factor, count(*) AS n_items FROM x GROUP BY 1""")
add("J7_ban_list", lambda s, d: sg.banned(contracts(s, d), events(s, d)[1].where("event_date >= DATE '2001-07-30'").select("symbol").distinct()),
    "symbol",
    f"WITH {UNIVERSE}, {EVENTS}\nSELECT symbol || '26MAYFUT' AS symbol FROM universe WHERE symbol IN (SELECT symbol FROM events0 WHERE source = 'BSE' AND event_date >= DATE '2001-07-30')")

# ---- events -----------------------------------------------------------------------

_cls = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(upper(description), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in tx.EVENT_WORDS) + " ELSE 'OTHER' END"


def _imp(field):
    i = {"action": 2, "factor": 3, "pause": 4}[field]
    dflt = {"action": "'NORMAL'", "factor": "1", "pause": "0"}[field]
    return "CASE " + " ".join(
        f"WHEN event_type = '{r[0]}' AND days_until <= {r[1]} THEN {repr(r[i])}" for r in tx.EVENT_IMPACT) + f" ELSE {dflt} END"


_EV = f"""{EVENTS}, ec AS (SELECT *, {_cls} AS event_type FROM events0),
em AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY symbol, event_date, event_type ORDER BY CASE source WHEN 'NSE' THEN 0 ELSE 1 END, description) = 1)"""
_AS = "1998-06-15"
_ASTS = "1998-06-15 09:00:00"
_rank = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(tx.EVENT_RANK)) + " END"
_UP = f"""{_EV}, {UNIVERSE}, up AS (SELECT symbol || '26MAYFUT' AS contract, em.*, event_date - DATE '{_AS}' AS days_until FROM em JOIN universe USING (symbol)
  WHERE event_date - DATE '{_AS}' BETWEEN 0 AND 7),
be AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY contract ORDER BY {_rank}, days_until, description) = 1),
es AS (SELECT u.symbol || '26MAYFUT' AS contract, event_type, event_date, days_until, {_imp('action')} AS action, {_imp('factor')} AS factor,
  {_imp('pause')} AS pause_minutes, event_type IS NOT NULL AS has_event FROM universe u LEFT JOIN be ON be.contract = u.symbol || '26MAYFUT')"""


def _ev(s, d):
    return sg.merge_events(list(events(s, d)))


def _evs(s, d):
    return sg.event_signals(_ev(s, d), contracts(s, d), _AS)


add("F19_event_class", lambda s, d: events(s, d)[0].unionByName(events(s, d)[1]).withColumn("event_type", tx.event_class(F.col("description")))
    .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type n:l", f"WITH {_EV}\nSELECT event_type, count(*) AS n FROM ec GROUP BY 1")
add("U3_event_union", _ev, "symbol event_date:d event_type source", f"WITH {_EV}\nSELECT * FROM em")
add("J9_upcoming_events", lambda s, d: sg.upcoming(_ev(s, d), contracts(s, d), _AS), "contract event_date:d event_type days_until:l",
    f"WITH {_UP}\nSELECT * FROM up")
add("F20_event_impact",
    lambda s, d: sg.upcoming(_ev(s, d), contracts(s, d), _AS, 30).withColumn("_i", tx.event_impact(F.col("event_type"), F.col("days_until"))).select("*", "_i.*"),
    "contract event_date:d event_type action factor:4 pause_minutes:l",
    f"""WITH {_UP.replace('BETWEEN 0 AND 7', 'BETWEEN 0 AND 30')}
SELECT *, {_imp('action')} AS action, {_imp('factor')} AS factor, {_imp('pause')} AS pause_minutes FROM up""")
add("W35_best_event", _evs, "contract event_type event_date:d days_until:l", f"WITH {_UP}\nSELECT * FROM es")
add("C10_event_signals", _evs, "contract event_type days_until:l action factor:4 pause_minutes:l has_event:b", f"WITH {_UP}\nSELECT * FROM es")


def _worst(s, d):
    items = _clamped(s, d)
    return sg.worst_news(items, _links(s, d, items))


_WORST = f"""{_MRG}, {_CL}, {_LK}, ws AS (SELECT lk.contract, cl.* FROM lk JOIN cl USING (id) WHERE scored QUALIFY row_number() OVER (PARTITION BY contract ORDER BY uncertainty DESC, id) = 1)"""
add("W35_worst_news", _worst, "contract id uncertainty:4 mm_action", f"WITH {_WORST}\nSELECT * FROM ws")


def _signals(s, d):
    parts = sg.components(_evs(s, d), _worst(s, d), _ASTS)
    return sg.aggregate_signals(parts, contracts(s, d), _ASTS)


_AGG = f"""{_WORST}, {_UP.replace(UNIVERSE + ', ', '')},
nw AS (SELECT contract, CASE WHEN mm_action = 'WIDEN' AND uncertainty < 4e-1 THEN 'NORMAL' ELSE mm_action END AS action,
  CASE WHEN mm_action = 'WIDEN' AND uncertainty < 4e-1 THEN 1 ELSE widen_factor END AS factor, pause_minutes, sentiment, uncertainty, informed_flow_risk, event_type AS net FROM ws),
jn AS (SELECT es.contract AS symbol, es.action AS ea, es.factor AS ef, CASE WHEN es.action = 'PAUSE' AND es.pause_minutes > 0 THEN es.pause_minutes END AS ep,
  nw.action AS na, nw.factor AS nf, CASE WHEN nw.action = 'PAUSE' AND nw.pause_minutes > 0 THEN nw.pause_minutes END AS np, es.event_type, es.event_date, days_until, has_event,
  sentiment, uncertainty, coalesce(informed_flow_risk, 'LOW') AS risk, net FROM es LEFT JOIN nw USING (contract)),
ag AS (SELECT symbol, CASE WHEN ea = 'AVOID' THEN 'AVOID' WHEN ea = 'PAUSE' OR na = 'PAUSE' THEN 'PAUSE' WHEN ea = 'WIDEN' OR na = 'WIDEN' THEN 'WIDEN' ELSE 'NORMAL' END AS mm_action,
  round(least(greatest(ef, 1) * greatest(coalesce(nf, 1), 1), 4) + 1e-9, 2) AS widen_factor, least(ep, np) * 60 AS pause_seconds, greatest(ep, np) * 60 AS pause_seconds_latest,
  CASE WHEN coalesce(na, 'NORMAL') <> 'NORMAL' THEN 'NEWS' WHEN ea <> 'NORMAL' THEN CASE event_type WHEN 'EARNINGS' THEN 'EARNINGS' ELSE 'CORPORATE' END ELSE 'DEFAULT' END AS source,
  CASE WHEN ea = 'NORMAL' AND coalesce(na, 'NORMAL') = 'NORMAL' THEN 'All clear' ELSE concat_ws(' | ', CASE WHEN ea <> 'NORMAL' THEN '[EVENTS] ' || event_type || ' in ' || days_until || ' day(s)' END,
    CASE WHEN coalesce(na, 'NORMAL') <> 'NORMAL' THEN '[NEWS] news ' || net END) END AS reason,
  coalesce(sentiment, 0) AS news_sentiment, coalesce(uncertainty, 0) AS news_uncertainty, coalesce(na, 'NORMAL') <> 'NORMAL' AS active_news, has_event AS has_upcoming_event, event_type, event_date, 0.9 AS confidence, 0.5 AS mm_suitability,
  days_until AS days_to_event, CASE WHEN has_event AND ea IN ('PAUSE', 'AVOID') THEN 'HIGH' WHEN has_event AND ea = 'WIDEN' AND risk = 'LOW' THEN 'MEDIUM' ELSE risk END AS asymmetry_risk FROM jn)"""


def _sec(df):
    base = F.unix_timestamp("generated_at")
    return df.withColumns({"pause_seconds": F.unix_timestamp("pause_until") - base, "pause_seconds_latest": F.unix_timestamp("pause_until_latest") - base})


add("C12_signal_aggregation", lambda s, d: _sec(_signals(s, d)),
    "symbol mm_action widen_factor:4 pause_seconds:l pause_seconds_latest:l source reason news_sentiment:4 news_uncertainty:4 active_news:b "
    "has_upcoming_event:b event_type event_date:d days_to_event:l asymmetry_risk confidence:2 mm_suitability:2", f"WITH {_AGG}\nSELECT * FROM ag")
add("F22_effective_widening", lambda s, d: sg.effective_widening(_signals(s, d), "1998-06-15 09:10:00"), "symbol is_paused:b is_stale:b effective_factor:4",
    f"""WITH {_AGG}, z AS (SELECT *, CASE WHEN mm_action NOT IN ('PAUSE', 'AVOID') THEN FALSE WHEN pause_seconds IS NULL THEN mm_action = 'AVOID' ELSE 600 < pause_seconds END AS is_paused FROM ag)
SELECT *, FALSE AS is_stale, CASE WHEN is_paused THEN 999 ELSE round(greatest(widen_factor, CASE days_to_event WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 15e-1 WHEN 3 THEN 15e-1 ELSE 0 END,
  CASE asymmetry_risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 12e-1 ELSE 0 END) + 1e-9, 2) END AS effective_factor FROM z""")


def _history(s, d, o=None):
    """Orders as a history of signals: an urgent order asks for a pause, its price sets the factor."""
    o = table(s, d, "orders") if o is None else o
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return o.selectExpr("*", "concat('C', cast(o_custkey as string)) AS symbol").select(
        "symbol", at.alias("generated_at"), (at + F.make_dt_interval(days=F.lit(30))).alias("expires_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "WIDEN").otherwise("PAUSE").alias("mm_action"),
        (1 + F.col("o_totalprice") / 1000000).alias("widen_factor"))


add("C13_current_signals",
    lambda s, d: sg.current_signals(_history(s, d), table(s, d, "customer").selectExpr("concat('C', cast(c_custkey as string)) AS symbol"), "1998-06-15 12:00:00"),
    "symbol is_default:b mm_action widen_factor:9",
    """WITH h AS (SELECT 'C' || o_custkey AS symbol, o_orderdate + to_minutes(o_orderkey % 1440) AS g, CASE o_orderpriority WHEN '5-LOW' THEN 'WIDEN' ELSE 'PAUSE' END AS a, 1 + o_totalprice / 1000000 AS f FROM orders),
l AS (SELECT * FROM h WHERE g <= TIMESTAMP '1998-06-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY g DESC) = 1),
v AS (SELECT * FROM l WHERE g + INTERVAL 30 DAY >= TIMESTAMP '1998-06-15 12:00:00'), c AS (SELECT DISTINCT 'C' || c_custkey AS symbol FROM customer)
SELECT symbol, a IS NULL AS is_default, coalesce(a, 'NORMAL') AS mm_action, coalesce(f, 1) AS widen_factor FROM c LEFT JOIN v USING (symbol)""")
add("C14_universe_ranking",
    lambda s, d: sg.rank_universe(table(s, d, "supplier").selectExpr("s_name AS symbol", "s_acctbal / 10000 AS mm_suitability")),
    "symbol rank:l mm_suitability:6 recommendation",
    """WITH x AS (SELECT s_name AS symbol, s_acctbal / 10000 AS mm_suitability FROM supplier)
SELECT *, rank() OVER (ORDER BY mm_suitability DESC) AS rank, CASE WHEN mm_suitability >= 7e-1 THEN 'TIER1' WHEN mm_suitability >= 4e-1 THEN 'TIER2' ELSE 'AVOID' END AS recommendation FROM x""")
