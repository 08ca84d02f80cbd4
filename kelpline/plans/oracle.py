"""DuckDB SQL for the registered queries: the same observations and rules, written down once more."""

from __future__ import annotations

from kelpline.operators.fusion import RULE_DOMAIN, RULE_WEIGHT
from kelpline.plans.queries import DAY, NOW, SIX_HOURS
from kelpline.sources.dims import SOURCES, WATCHBOXES

R = "6371008.8e0"
KT = "0.514444e0"
H = 3_600_000


def f(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def hav(a, b, c, d):
    return f"(asin(least(1e0, sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))*(2*{R}))"


def brg(a, b, c, d):
    return f"((degrees(atan2(sin(radians({d}-{b}))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-{b}))))+360)%360)"


def dest(a, b, t, m):
    d = f"({m}/{R})"
    s = f"(sin(radians({a}))*cos({d})+cos(radians({a}))*sin({d})*cos(radians({t})))"
    lat = f"degrees(asin(greatest(-1e0,least(1e0,{s}))))"
    lon = f"(({b}+degrees(atan2(sin(radians({t}))*sin({d})*cos(radians({a})), cos({d})-sin(radians({a}))*{s}))+540)%360-180)"
    return lat, lon


def delta(a, b):
    d = f"(({b}-{a}+540)%360-180)"
    return f"(CASE WHEN {d}<=-180 THEN {d}+360 ELSE {d} END)"


def jsr(x):
    return f"floor({x}+0.5e0)::BIGINT"


def q(ms, b):
    return f"(({ms})//{b}*{b})"


def gh(lat, lon, p=5):
    n_lon, n_lat = (5 * p + 1) // 2, 5 * p // 2
    x = f"greatest(0,least({(1 << n_lon) - 1},floor(({lon}+180e0)/360e0*{1 << n_lon})::BIGINT))"
    y = f"greatest(0,least({(1 << n_lat) - 1},floor(({lat}+90e0)/180e0*{1 << n_lat})::BIGINT))"
    out = []
    for k in range(p):
        bits = []
        for j in range(5):
            i = 5 * k + j
            src, n = (y, n_lat) if i % 2 else (x, n_lon)
            bits.append(f"(({src}>>{n - 1 - i // 2})&1)*{16 >> j}")
        out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz',1+({'+'.join(bits)})::INT,1)")
    return "(" + "||".join(out) + ")"


def first_box(lat, lon):
    return f"(SELECT min(bid) FROM box WHERE {lat} BETWEEN mila AND mala AND {lon} BETWEEN milo AND malo)"


def capped(x):
    return f"least(100,{jsr(x)})::INT"


BOX = "box(bid,bkey,blabel,mila,milo,mala,malo,thr) AS (VALUES " + ",".join(f"({i},'{k}','{n.replace(chr(39), chr(39) * 2)}',{f(a)},{f(b)},{f(c)},{f(d)},{t})" for i, (k, n, a, b, c, d, t) in enumerate(WATCHBOXES)) + ")"

OBS = f"""{BOX}, ev AS (SELECT event_id, epoch_us(ts)//1000 AS ts_ms, user_id, event_type, value, CAST(props->>'$.k' AS INT) AS k, user_id%8 AS u,
  CASE WHEN user_id%3=0 THEN 1.6e0 ELSE 0.25e0 END AS s FROM events),
obs AS MATERIALIZED (SELECT *, {gh("lat", "lon", 5)} AS geohash5 FROM (SELECT event_id AS obs_id, ts_ms, CASE WHEN u<=2 THEN 2 WHEN u<=5 THEN 1 WHEN u=6 THEN 4 ELSE 5 END AS domain,
  CASE WHEN u<=2 THEN 'sea:'||user_id WHEN u<=5 THEN 'air:'||user_id WHEN u=6 THEN 'geo:'||event_id ELSE 'thermal:'||event_id END AS entity_id,
  mila+(mala-mila)*((event_id*7919+user_id*104729)%10007)/10007e0*s AS lat, milo+(malo-milo)*((event_id*6007+user_id*15485863)%10009)/10009e0*s AS lon,
  CASE WHEN u BETWEEN 3 AND 5 THEN 3000e0+k*100 WHEN u=6 THEN -(k%12)*1000e0 END AS alt_m,
  (floor(value)%25+0.5e0)*(CASE WHEN u BETWEEN 3 AND 5 THEN 18e0 ELSE 1e0 END) AS sog_kt, ((event_id*53)%360)::DOUBLE AS cog_deg,
  CASE WHEN u BETWEEN 3 AND 5 THEN (CASE WHEN k<=40 THEN 2 ELSE 0 END)+(CASE WHEN user_id%11=0 THEN 32 ELSE 0 END)+(CASE WHEN event_type='signup' AND k<10 THEN 64 ELSE 0 END) ELSE 0 END AS flags,
  CASE WHEN u<=2 THEN (['crude oil tanker','cargo','pilot','fishing','bulk carrier'])[user_id%5+1] WHEN u<=5 THEN (['jet','B738','turboprop'])[user_id%3+1] END AS kind, 'E'||user_id AS label,
  CASE WHEN u BETWEEN 3 AND 5 THEN CASE k WHEN 7 THEN '7700' WHEN 8 THEN '7600' WHEN 9 THEN '7500' END END AS squawk,
  CASE WHEN u=6 THEN 2e0+value/50 END AS mag, CASE WHEN u=6 THEN (k%12)::DOUBLE END AS depth_km, CASE WHEN u=7 THEN value END AS frp,
  CASE WHEN u<=2 THEN 3 WHEN u<=5 THEN 1 WHEN u=6 THEN 5 ELSE 6 END AS source_id, event_id//100 AS provenance_id, user_id, event_type
  FROM ev JOIN box ON bid=(user_id//8)%10))"""

BURST = f"""burst AS MATERIALIZED (SELECT *, seed*100+step AS obs_id FROM (
  SELECT obs_id AS seed, i AS step, ts_ms+i*60000 AS ts_ms, ts_ms+49*60000 AS now_ms, 1 AS domain, 'air:'||obs_id AS entity_id,
    lat+(CASE WHEN event_type='view' THEN sin(radians(i*18e0))*0.37e0 ELSE i*0.11e0 END) AS lat, lon+(CASE WHEN event_type='view' THEN cos(radians(i*18e0))*0.37e0/cos(radians(lat)) ELSE 0e0 END) AS lon,
    9144e0 AS alt_m, 420e0 AS sog_kt, flags, kind, '' AS label FROM obs, range(50) AS t(i) WHERE domain=1 AND event_type IN ('view','error')
  UNION ALL SELECT obs_id, i, ts_ms+i*60000, ts_ms+49*60000, 2, 'sea:'||obs_id||'-'||h, lat+h*0.0018e0+(CASE WHEN i<20 THEN (20-i)*0.003e0*(1-2*h) ELSE 0e0 END), lon,
    NULL, CASE WHEN i<20 THEN 10e0 ELSE 0.3e0 END, flags, kind, 'E'||obs_id||'-'||h FROM obs, range(50) AS t(i), range(2) AS v(h) WHERE domain=2 AND event_type='purchase'))"""

GAPS = f"""d0 AS (SELECT *, lag(ts_ms) OVER w AS p_ts, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(sog_kt) OVER w AS p_sog, lag(cog_deg) OVER w AS p_cog, lag(flags) OVER w AS p_flags
  FROM obs WHERE domain IN (1,2) WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, obs_id)),
d1 AS (SELECT *, ts_ms-p_ts AS dt, {first_box("p_lat", "p_lon")} AS fb FROM d0 WHERE ts_ms-p_ts>=300000),
d2 AS (SELECT d1.*, bkey, (d1.ts_ms-p_ts)/1000e0 AS gap, {hav("p_lat", "p_lon", "lat", "lon")} AS dist, {brg("p_lat", "p_lon", "lat", "lon")} AS bearing,
  CASE WHEN domain=2 THEN (CASE WHEN kind LIKE '%tanker%' THEN 1 WHEN kind LIKE '%cargo%' OR kind LIKE '%bulk%' THEN 2 WHEN kind LIKE '%craft%' OR kind LIKE '%pilot%' THEN 3 ELSE 4 END)
    ELSE (CASE WHEN kind LIKE '%prop%' THEN 5 WHEN kind LIKE '%jet%' THEN 6 ELSE 7 END) END AS p
  FROM d1 LEFT JOIN box ON bid=fb WHERE dt>=coalesce(thr,3600)*1000 AND NOT (domain=2 AND p_sog<0.4) AND NOT (domain=1 AND (p_flags&64)<>0)),
d3 AS (SELECT *, ([18e0,24e0,45e0,30e0,300e0,620e0,560e0])[p] AS mx, ([18e0,22e0,60e0,28e0,300e0,240e0,260e0])[p] AS drift, ([5e0,6e0,12e0,8e0,6e0,4e0,5e0])[p] AS eps, ([0e0,0e0,0e0,0e0,0.3e0,0.35e0,0.3e0])[p] AS decay FROM d2),
d4 AS (SELECT *, mx*{KT}*gap AS rmax, p_sog*decay*{KT}*gap AS rmin, least(180e0,eps+drift*(gap/3600)) AS half, CASE WHEN gap>0 THEN dist/{KT}/gap ELSE 0e0 END AS implied FROM d3),
d5 AS (SELECT *, greatest(0e0,dist-rmax) AS ex, CASE WHEN half>=180 THEN 0e0 ELSE greatest(0e0,abs({delta("p_cog", "bearing")})-half) END AS off, greatest(0e0,rmin-dist) AS short FROM d4),
g AS (SELECT *, CASE WHEN ex>0 THEN 'IMPOSSIBLE_TRANSIT' WHEN off>0 THEN 'COURSE_DISCONTINUITY' WHEN short>0 THEN 'IMPLAUSIBLE_LOITER' ELSE 'CONSISTENT' END AS verdict,
  {jsr("least(100e0,(CASE WHEN ex>0 THEN greatest(0e0,least(1e0,0.55e0+0.3e0*log2(greatest(1.001e0,implied/mx))))*100 WHEN off>0 THEN greatest(0e0,least(1e0,0.25e0+off/240))*100 WHEN short>0 THEN greatest(0e0,least(1e0,0.2e0+short/greatest(1e0,rmin)/2))*100 ELSE 0e0 END)*(0.75e0+0.25e0*least(1e0,gap/21600)))")} AS score FROM d5)"""

THERMAL = f"th AS (SELECT 'THERMAL_ANOMALY' AS rule, {capped('28+log10(frp)*22+(CASE WHEN fb IS NOT NULL THEN 15 ELSE 0 END)')} AS severity, ts_ms AS ts_start, NULL::BIGINT AS ts_end, lat, lon, geohash5, entity_id AS entities, obs_id, (SELECT bkey FROM box WHERE bid=fb) AS bkey FROM (SELECT *, {first_box('lat', 'lon')} AS fb FROM obs WHERE domain=5 AND frp>=40))"
SEISMIC = f"se AS (SELECT 'SEISMIC_SHALLOW' AS rule, {capped('25+mag*9+(6-depth_km)*3')} AS severity, ts_ms AS ts_start, NULL::BIGINT AS ts_end, lat, lon, geohash5, entity_id AS entities, obs_id FROM obs WHERE domain=4 AND mag>=3.2 AND depth_km<=6)"
SQUAWK = f"sq AS (SELECT 'SQUAWK_EMERGENCY' AS rule, CASE squawk WHEN '7500' THEN 100 WHEN '7600' THEN 62 ELSE 88 END AS severity, {q('ts_ms', H)} AS ts_start, ts_ms AS ts_end, lat, lon, geohash5, entity_id AS entities, obs_id, label, squawk FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, ts_ms//30000 ORDER BY ts_ms, obs_id) AS rn FROM obs WHERE domain=1 AND squawk IS NOT NULL) WHERE rn=1)"
REACQ = "re AS (SELECT * FROM (SELECT CASE WHEN verdict='IMPOSSIBLE_TRANSIT' THEN 'SPOOF_DISCONTINUITY' ELSE 'DARK_VESSEL' END AS rule, " + capped("score*(CASE WHEN fb IS NOT NULL THEN 1.15e0 ELSE 1e0 END)") + " AS severity, p_ts AS ts_start, ts_ms AS ts_end, lat, lon, geohash5, entity_id AS entities, obs_id FROM g WHERE verdict<>'CONSISTENT') WHERE severity>=25)"
SLIM = "rule, severity, ts_start, ts_end, round(lat,5) AS lat, round(lon,5) AS lon, entities"

#: Emergency codes repeat by hour, place and aircraft: of one key the strongest stays, then by hash.
SQ_ONE = """sqh AS (SELECT *, sha256('{"entityIds":["'||entities||'"],"evidence":{"squawk":"'||squawk||'"},"lat":'||printf('%.6f',lat::DECIMAL(10,6))||',"lon":'||printf('%.6f',lon::DECIMAL(10,6))||',"rule":"'||rule||'","tsStart":'||ts_start||'}') AS hash FROM sq),
sq1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_start, entities, geohash5 ORDER BY severity DESC, hash) AS rn FROM sqh) WHERE rn=1)"""
SIMPLE = f"{OBS}, {THERMAL}, {SEISMIC}, {SQUAWK}, {SQ_ONE}"
CELLS = f"""simple AS MATERIALIZED (SELECT *, (ts_start//{SIX_HOURS}) AS run FROM (
  SELECT obs_id*1000000+(ts_start//{H})%1000000 AS id, rule, severity, ts_start, coalesce(ts_end,ts_start) AS ts_end, lat, lon, bkey FROM th
  UNION ALL SELECT obs_id*1000000+(ts_start//{H})%1000000, rule, severity, ts_start, ts_start, lat, lon, NULL FROM se
  UNION ALL SELECT -(CAST(split_part(entities,':',2) AS BIGINT)*1000000+(ts_start//{H})%1000000), rule, severity, ts_start, coalesce(ts_end,ts_start), lat, lon, NULL FROM sq1)),
edges AS MATERIALIZED (SELECT a.id AS a_id, b.id AS b_id FROM simple a JOIN simple b ON a.id<b.id AND abs(a.ts_start-b.ts_start)<={90 * 60000} AND {hav("a.lat", "a.lon", "b.lat", "b.lon")}<=150000)"""
REACH = "both_ways AS (SELECT a_id AS x, b_id AS y FROM edges UNION SELECT b_id, a_id FROM edges), reach(x,y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y=e.x), cl AS MATERIALIZED (SELECT x AS id, min(y) AS cluster FROM reach GROUP BY x)"


def case(values: dict, default: str) -> str:
    return "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}{'e0' if isinstance(v, float) else ''}" for k, v in values.items()) + f" ELSE {default} END"


INCIDENTS = f"""m AS MATERIALIZED (SELECT s.*, cluster, {case(RULE_DOMAIN, "NULL")} AS dom, severity*{case(RULE_WEIGHT, "1e0")} AS wt, greatest(1,severity) AS w FROM simple s JOIN cl USING (id)),
mr AS (SELECT *, wt*pow(0.45e0, row_number() OVER (PARTITION BY cluster ORDER BY wt DESC, id)-1) AS part FROM m),
inc AS (SELECT cluster, count(*) AS members, count(DISTINCT dom) AS n_domains, min(ts_start) AS ts_start, max(ts_end) AS ts_end, sum(lat*w)/sum(w) AS lat, sum(lon*w)/sum(w) AS lon,
  least(100,{jsr("sum(part)*(1+0.16e0*(count(DISTINCT dom)-1))*0.72e0")})::INT AS severity, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids,
  first(rule ORDER BY severity DESC, ts_start, id) AS lead FROM mr GROUP BY cluster),
big AS (SELECT inc.*, greatest(1,{jsr("max(" + hav("inc.lat", "inc.lon", "m.lat", "m.lon") + ")/1000")}) AS radius_km FROM inc JOIN m USING (cluster) WHERE members>=2 AND n_domains>=2 GROUP BY ALL)"""

FOUND_TABLE = f"{OBS}, {GAPS}, {REACQ}, {THERMAL}, {SEISMIC}, {SQUAWK}, {SQ_ONE}"
#: The sparse rules of run_detectors, without the interference rule, which needs more aircraft in half a minute than there are.
FOUND = f"""{FOUND_TABLE}, re1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, ts_start, entities, geohash5 ORDER BY severity DESC) AS rn FROM re) WHERE rn=1),
found AS (SELECT rule, severity, ts_start, ts_end, lat, lon, entities FROM re1 UNION ALL SELECT rule, severity, ts_start, ts_end, lat, lon, entities FROM th
  UNION ALL SELECT rule, severity, ts_start, ts_end, lat, lon, entities FROM se UNION ALL SELECT rule, severity, ts_start, ts_end, lat, lon, entities FROM sq1)"""

LOG = """log AS MATERIALIZED (SELECT event_id//100 AS id, min(epoch_us(ts)//1000) AS fetched_ms, string_agg(printf('%012d',event_id)||':'||props, chr(10) ORDER BY event_id) AS payload, count(*) AS record_count,
  ((event_id//100)%7+1)::INT AS source_id, CASE WHEN (event_id//100)%13=0 THEN 500 ELSE 200 END AS http_status FROM events GROUP BY event_id//100)"""
CHAIN = f"""{LOG}, nl AS MATERIALIZED (SELECT source_id, id, sha256(payload) AS payload_sha, row_number() OVER (PARTITION BY source_id ORDER BY id) AS i FROM log),
chain AS MATERIALIZED (WITH RECURSIVE c AS (SELECT source_id, id, i, payload_sha, repeat('0',64) AS prev_sha, sha256(repeat('0',64)||payload_sha) AS chain_sha FROM nl WHERE i=1
  UNION ALL SELECT n.source_id, n.id, n.i, n.payload_sha, c.chain_sha, sha256(c.chain_sha||n.payload_sha) FROM c JOIN nl n ON n.source_id=c.source_id AND n.i=c.i+1) SELECT * FROM c)"""

NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_ms DESC, obs_id) AS rn FROM {src}) WHERE rn=1"


def newest(src, keys="entity_id"):
    return NEWEST.format(src=src, keys=keys)


STATE = """st AS (SELECT entity_id, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS n_obs, first(domain ORDER BY ts_ms DESC, obs_id) AS domain, first(lat ORDER BY ts_ms DESC, obs_id) AS lat,
  first(lon ORDER BY ts_ms DESC, obs_id) AS lon, first(flags ORDER BY ts_ms DESC, obs_id) AS flags, first(geohash5 ORDER BY ts_ms DESC, obs_id) AS geohash5, first(sog_kt ORDER BY ts_ms DESC, obs_id) AS sog_kt,
  first(cog_deg ORDER BY ts_ms DESC, obs_id) AS cog_deg, first(alt_m ORDER BY ts_ms DESC, obs_id) AS alt_m, first(label ORDER BY ts_ms DESC, obs_id) AS label, first(kind ORDER BY ts_ms DESC, obs_id) AS kind,
  count(DISTINCT source_id)::INT AS n_sources FROM {src} GROUP BY entity_id)"""

VIEWPORT = "lat BETWEEN -5 AND 30 AND lon>=95 AND lon<=125"
AIRBORNE = "domain=1 AND (flags&64)=0"


def _cell_bounds(c: str, p: int = 5) -> dict[str, str]:
    """Bounds of a cell from its characters."""
    v = [f"(instr('0123456789bcdefghjkmnpqrstuvwxyz',substr({c},{k + 1},1))-1)" for k in range(p)]
    n_lon, n_lat = (5 * p + 1) // 2, 5 * p // 2
    lon, lat = [], []
    for i in range(5 * p):
        bit = f"(({v[i // 5]}>>{4 - i % 5})&1)"
        (lat if i % 2 else lon).append(bit)
    x = "+".join(f"{b}*{1 << (n_lon - 1 - i)}" for i, b in enumerate(lon))
    y = "+".join(f"{b}*{1 << (n_lat - 1 - i)}" for i, b in enumerate(lat))
    return {"min_lon": f"(({x})*{f(360 / (1 << n_lon))}-180)", "max_lon": f"(({x}+1)*{f(360 / (1 << n_lon))}-180)", "min_lat": f"(({y})*{f(180 / (1 << n_lat))}-90)", "max_lat": f"(({y}+1)*{f(180 / (1 << n_lat))}-90)"}


_B = _cell_bounds("geohash5")
_TO, _EX = dest("p_lat", "p_lon", "cog_deg", "25000e0"), dest("p_lat", "p_lon", "cog_deg", f"(sog_kt*{KT}*3600)")
_RD = f"""ships AS (SELECT b.*, count(*) OVER (PARTITION BY now_ms, cell) AS dens FROM (SELECT *, {gh("lat", "lon", 5)} AS cell FROM burst WHERE domain=2 AND step=49 AND sog_kt<1.2) b),
fit AS (SELECT * FROM ships WHERE dens<6 AND NOT regexp_matches(kind, 'pilot|fishing')),
pr AS (SELECT a.now_ms, a.entity_id AS ia, b.entity_id AS ib, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, a.kind AS ka, b.kind AS kb, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS sep
  FROM fit a JOIN fit b ON a.now_ms=b.now_ms AND a.cell=b.cell AND a.entity_id<b.entity_id AND a.label<>b.label),
legs AS (SELECT *, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS leg FROM burst WHERE domain=2 WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms)),
tr AS (SELECT entity_id, sum(leg) AS path, max(CASE WHEN step=24 THEN lat END) AS tlat, max(CASE WHEN step=24 THEN lon END) AS tlon, max(CASE WHEN step=24 THEN ts_ms END) AS tts FROM legs WHERE step>0 OR leg IS NULL GROUP BY entity_id),
rv AS (SELECT pr.*, (alat+blat)/2 AS lat, (alon+blon)/2 AS lon, greatest(x.tts,y.tts) AS since, {first_box("alat", "alon")} AS fb FROM pr JOIN tr x ON x.entity_id=ia JOIN tr y ON y.entity_id=ib
  WHERE sep>=25 AND sep<=400 AND (x.path>=3000 OR y.path>=3000) AND {hav("x.tlat", "x.tlon", "y.tlat", "y.tlon")}<=900),
rd AS (SELECT 'RENDEZVOUS' AS rule, {capped("28+(CASE WHEN ka LIKE '%tanker%' AND kb LIKE '%tanker%' THEN 30 WHEN regexp_matches(ka,'tanker|cargo|bulk') AND regexp_matches(kb,'tanker|cargo|bulk') THEN 18 ELSE 0 END)+(CASE WHEN fb IS NOT NULL THEN 10 ELSE 0 END)+least(14e0,(400-sep)/28)+least(14e0," + jsr("(now_ms-since)/60000e0") + "/6e0)")} AS severity,
  {q("since", 30 * 60000)} AS ts_start, NULL::BIGINT AS ts_end, lat, lon, ia||','||ib AS entities FROM rv)"""

_BASE_DAY = f"hid AS (SELECT * FROM obs WHERE NOT (domain=1 AND (ts_ms//{DAY})%10=7 AND ((user_id//8)%10)%3=1)), air AS (SELECT *, {gh('lat', 'lon', 2)} AS cell, {q('ts_ms', DAY)} AS tick FROM hid WHERE {AIRBORNE}), live AS (SELECT cell, tick, count(*) AS n FROM air GROUP BY ALL), base AS (SELECT cell, count(*) AS c, avg(n) AS mean, stddev_samp(n) AS sd FROM live GROUP BY cell HAVING count(*)>=8)"

ORACLE: dict[str, str] = {
    "reacq_verdicts": f"WITH {OBS}, {GAPS} SELECT domain, verdict, count(*) AS n, sum(score)::BIGINT AS score_sum, max(score) AS score_max FROM g GROUP BY ALL",
    "geohash_cells": f"WITH {OBS} SELECT obs_id, {gh('lat', 'lon', 4)} AS geohash4, geohash5, {gh('lat', 'lon', 7)} AS geohash7 FROM obs",
    "bounds_cells": f"WITH {OBS} SELECT geohash5, count(*) AS n, {', '.join(f'round({v},9) AS {k}' for k, v in _B.items())}, round(({_B['min_lat']}+{_B['max_lat']})/2,9) AS lat, round(({_B['min_lon']}+{_B['max_lon']})/2,9) AS lon, 6 AS target_precision FROM obs GROUP BY geohash5",
    "bearing_destination": f"WITH {OBS}, x AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM obs WHERE domain IN (1,2) WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, obs_id)) SELECT obs_id, round({brg('p_lat', 'p_lon', 'lat', 'lon')},6) AS bearing, round({hav('p_lat', 'p_lon', 'lat', 'lon')},3) AS dist_m, round({_TO[0]},6) AS to_lat, round({_TO[1]},6) AS to_lon, round({_EX[0]},6) AS ex_lat, round({_EX[1]},6) AS ex_lon FROM x WHERE p_lat IS NOT NULL",
    "viewport_filter": f"WITH {OBS} SELECT domain, count(*) AS n, min(obs_id) AS first_id, round(max(lat),6) AS max_lat FROM obs WHERE {VIEWPORT} GROUP BY domain",
    "watchbox_first_match": f"WITH {OBS} SELECT bkey AS box_key, domain, count(*) AS n, sum(thr)::BIGINT AS threshold_sum FROM (SELECT *, {first_box('lat', 'lon')} AS fb FROM obs) LEFT JOIN box ON bid=fb GROUP BY ALL",
    "current_state": f"WITH {OBS}, {STATE.format(src='obs')} SELECT entity_id, domain, first_seen, last_seen, n_obs, round(lat,6) AS lat, round(lon,6) AS lon, sog_kt, cog_deg, alt_m, label, kind, flags, geohash5 FROM st",
    "live_entities": f"WITH {OBS}, z AS (SELECT * FROM obs WHERE ts_ms<={NOW} AND ts_ms>{NOW - 6 * H}) SELECT entity_id, ts_ms AS last_seen, round(lat,6) AS lat, round(lon,6) AS lon FROM ({newest('z')})",
    "replay_snapshot": f"WITH {OBS}, z AS (SELECT * FROM obs WHERE domain IN (1,2) AND ts_ms<={NOW} AND ts_ms>{NOW - 12 * H}) SELECT entity_id, domain, ts_ms, round(lat,6) AS lat, round(lon,6) AS lon, flags FROM ({newest('z')})",
    "replay_every_6h": f"WITH {OBS}, z AS (SELECT *, -((-ts_ms)//{SIX_HOURS})*{SIX_HOURS} AS at_ms FROM obs), z2 AS (SELECT * REPLACE ((CASE WHEN ts_ms%{SIX_HOURS}=0 THEN ts_ms ELSE (ts_ms//{SIX_HOURS}+1)*{SIX_HOURS} END) AS at_ms) FROM z), y AS (SELECT * FROM z2 WHERE ts_ms>at_ms-{H}) SELECT at_ms, domain, count(*) AS n, max(obs_id) AS max_id FROM ({newest('y', 'entity_id, at_ms')}) GROUP BY ALL",
    "snapshot_delta": f"WITH {OBS}, z AS (SELECT * FROM obs WHERE ts_ms<={NOW - 60000} AND ts_ms>{NOW - 60000 - 8 * H}), y AS (SELECT * FROM obs WHERE ts_ms<={NOW + 2 * H} AND ts_ms>{NOW - 6 * H}), a AS (SELECT entity_id, ts_ms AS was, {NOW}-obs_id%40*1000 AS sent FROM ({newest('z')})), b AS (SELECT entity_id, ts_ms AS seen FROM ({newest('y')})) SELECT entity_id, CASE WHEN was IS NULL THEN 'new' WHEN seen IS NULL THEN 'gone' WHEN seen<>was THEN 'changed' WHEN {NOW}-sent>=20000 THEN 'resent' ELSE 'same' END AS change FROM a FULL JOIN b USING (entity_id)",
    "entity_tracks": f"WITH {OBS} SELECT entity_id, count(*) AS n, string_agg(obs_id::VARCHAR, ',' ORDER BY ts_ms, obs_id) AS ids FROM obs WHERE domain IN (1,2) AND ts_ms BETWEEN {NOW - 12 * H} AND {NOW} GROUP BY entity_id",
    "entity_profile": f"WITH {FOUND}, {STATE.format(src='obs')}, dd AS (SELECT entity_id, count(*) AS recent FROM obs WHERE ts_ms>{NOW - DAY} GROUP BY entity_id), de AS (SELECT entities AS entity_id, count(*) AS detections, max(severity) AS worst FROM found GROUP BY entities) SELECT entity_id, last_seen, n_obs, n_sources, coalesce(recent,0) AS recent, coalesce(detections,0) AS detections, worst FROM st LEFT JOIN dd USING (entity_id) LEFT JOIN de USING (entity_id)",
    "asof_positions": f"WITH {OBS}, ask AS (SELECT DISTINCT entity_id, {NOW}-k*{DAY} AS at_ms FROM obs, range(5) AS t(k) WHERE domain IN (1,2)) SELECT entity_id, at_ms, max(ts_ms) AS fix_ms, round(first(lat ORDER BY ts_ms DESC, obs_id DESC),6) AS lat, round(first(lon ORDER BY ts_ms DESC, obs_id DESC),6) AS lon FROM ask LEFT JOIN (SELECT entity_id, ts_ms, obs_id, lat, lon FROM obs) o USING (entity_id) WHERE o.ts_ms<=at_ms GROUP BY entity_id, at_ms UNION ALL SELECT entity_id, at_ms, NULL, NULL, NULL FROM ask WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entity_id=ask.entity_id AND o.ts_ms<=at_ms)",
    "track_geometry": f"WITH {OBS}, {BURST}, l AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg, row_number() OVER w AS rn FROM burst WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, obs_id)), t AS (SELECT entity_id, count(*) AS fixes, sum(CASE WHEN rn>1 THEN leg ELSE 0e0 END) AS path, first(lat ORDER BY ts_ms) AS a, first(lon ORDER BY ts_ms) AS b, last(lat ORDER BY ts_ms) AS c, last(lon ORDER BY ts_ms) AS d, max(ts_ms)-min(ts_ms) AS duration_ms FROM l GROUP BY entity_id) SELECT entity_id, fixes, round(path,1) AS path_m, round({hav('a', 'b', 'c', 'd')},1) AS net_m, duration_ms FROM t",
    "track_turns": f"WITH {OBS}, t AS (SELECT entity_id, abs({delta('lag(cog_deg) OVER w', 'cog_deg')}) AS turn, row_number() OVER w AS rn, count(*) OVER (PARTITION BY entity_id) AS n FROM obs WHERE domain IN (1,2) WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, obs_id)) SELECT entity_id, round(sum(CASE WHEN rn>1 THEN turn END),3) AS turn_deg, count(*) FILTER (WHERE (rn-1)%ceil(n/60e0)::BIGINT=0) AS drawn, max(n) AS n FROM t GROUP BY entity_id",
    "thinned_archive": f"WITH {OBS}, z AS (SELECT *, ts_ms//1800000 AS bk FROM obs WHERE ts_ms<{NOW - 12 * H} AND ts_ms>={NOW - 168 * H}), k AS (SELECT entity_id, obs_id FROM obs WHERE ts_ms>={NOW - 12 * H} UNION ALL SELECT entity_id, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, bk ORDER BY ts_ms DESC, obs_id DESC) AS rn FROM z) WHERE rn=1) SELECT entity_id, count(*) AS n, sum(obs_id)::BIGINT AS id_sum FROM k GROUP BY entity_id",
    "retention": f"WITH {OBS}, z AS (SELECT DISTINCT entity_id, ts_ms//1800000 AS bk FROM obs WHERE ts_ms<{NOW - 12 * H} AND ts_ms>={NOW - 168 * H}), c AS (SELECT count(*) FILTER (WHERE ts_ms>={NOW - 12 * H}) AS raw, count(*) FILTER (WHERE ts_ms<{NOW - 12 * H} AND ts_ms>={NOW - 168 * H}) AS old, count(*) FILTER (WHERE ts_ms<{NOW - 168 * H}) AS purged FROM obs) SELECT raw+(SELECT count(*) FROM z) AS kept, old-(SELECT count(*) FROM z) AS thinned, purged FROM c",
    "trim_oldest": f"WITH {OBS}, z AS (SELECT {q('ts_ms', DAY)} AS day_ms, count(*) AS n FROM obs WHERE domain<=2 GROUP BY 1) SELECT day_ms, n, sum(n) OVER (ORDER BY day_ms DESC)<=4000 AS kept FROM z",
    "going_dark": f"WITH {OBS}, z AS (SELECT * FROM obs WHERE ts_ms<={NOW}), l AS (SELECT *, ({NOW}-ts_ms)/1000e0 AS age, {first_box('lat', 'lon')} AS fb FROM ({newest('z')}) WHERE domain IN (1,2)) SELECT entity_id, domain, ts_ms AS went_dark_at, round(lat,6) AS lat, round(lon,6) AS lon, sog_kt, bkey AS box_key FROM l LEFT JOIN box ON bid=fb WHERE age>1800 AND age<129600 AND age>=coalesce(thr,3600) AND NOT (domain=2 AND sog_kt<0.4) AND NOT (domain=1 AND (flags&64)<>0)",
    "reacquisition": f"WITH {OBS}, {GAPS}, {REACQ} SELECT {SLIM} FROM re",
    "baseline_stats": f"WITH {OBS}, z AS (SELECT {gh('lat', 'lon', 2)} AS cell, {q('ts_ms', H)} AS t, count(*) AS n FROM obs WHERE {AIRBORNE} GROUP BY ALL), y AS (SELECT cell, ((t//{H}+96)%168)::INT AS how, n FROM z) SELECT cell, how, count(*) AS samples, round(avg(n),6) AS mean, round(stddev_samp(n),6) AS sd FROM y GROUP BY ALL HAVING count(*)>=2",
    "airspace_void": f"WITH {OBS}, {_BASE_DAY}, days AS (SELECT unnest(generate_series({q('min(ts_ms)', DAY)}, {q('max(ts_ms)', DAY)}, {DAY})) AS tick FROM hid), z AS (SELECT base.cell, days.tick, coalesce(live.n,0) AS observed, mean, sd FROM base CROSS JOIN days LEFT JOIN live ON live.cell=base.cell AND live.tick=days.tick WHERE mean>=8), y AS (SELECT *, (observed-mean)/greatest(1e0,sd) AS zz, 1-observed/mean AS dp FROM z) SELECT 'AIRSPACE_VOID' AS rule, {capped('40+abs(zz)*8+dp*25')} AS severity, tick AS ts_start, cell, observed FROM y WHERE zz<=-3 AND dp>=0.6",
    "gnss_bloom": f"WITH {OBS}, z AS (SELECT {gh('lat', 'lon', 2)} AS cell, {q('ts_ms', DAY)} AS tick, count(*) FILTER (WHERE (flags&2)<>0) AS degraded, count(*) AS total, avg(lat) FILTER (WHERE (flags&2)<>0) AS lat, avg(lon) FILTER (WHERE (flags&2)<>0) AS lon, count(DISTINCT CASE WHEN (flags&2)<>0 THEN entity_id END)::INT AS n_ids FROM obs WHERE {AIRBORNE} GROUP BY ALL) SELECT 'GNSS_BLOOM' AS rule, {capped('35+degraded/total*45+least(20,degraded)')} AS severity, tick AS ts_start, round(lat,5) AS lat, round(lon,5) AS lon, n_ids, degraded, total FROM z WHERE degraded>=5 AND total>=8 AND degraded/total>=0.35",
    "squawk_emergency": f"WITH {OBS}, {SQUAWK} SELECT {SLIM} FROM sq",
    "rendezvous": f"WITH {OBS}, {BURST}, {_RD} SELECT {SLIM} FROM rd WHERE severity>=45",
    "rendezvous_neighbours": f"WITH {OBS}, {BURST}, {_RD.replace(' AND a.cell=b.cell', '')} SELECT count(*) AS n, sum(severity)::BIGINT AS severity_sum FROM rd WHERE severity>=45",
    "loiter": f"""WITH {OBS}, {BURST}, e0 AS (SELECT *, {first_box("lat", "lon")} AS fb, {gh("lat", "lon", 4)} AS c4 FROM burst WHERE domain=1 AND step=49 AND (flags&64)=0),
e AS (SELECT * FROM e0 WHERE (flags&32)<>0 OR fb IS NOT NULL), t0 AS (SELECT *, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS leg, row_number() OVER w AS rn FROM burst WHERE domain=1 AND step>=4 WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms)),
t AS (SELECT entity_id, count(*) AS fixes, sum(CASE WHEN rn>1 THEN leg ELSE 0e0 END) AS path, first(lat ORDER BY ts_ms) AS a, first(lon ORDER BY ts_ms) AS b, last(lat ORDER BY ts_ms) AS c, last(lon ORDER BY ts_ms) AS d, max(ts_ms)-min(ts_ms) AS dur FROM t0 GROUP BY entity_id),
j AS (SELECT e.*, path, {hav("a", "b", "c", "d")}/path AS straight, dur FROM e JOIN t USING (entity_id) WHERE path>=150000 AND dur>=1500000 AND fixes>=12), k AS (SELECT *, count(*) OVER (PARTITION BY now_ms, c4) AS alike FROM j WHERE straight<=0.25)
SELECT 'LOITER' AS rule, {capped("35+(1-straight)*40+(CASE WHEN (flags&32)<>0 THEN 18 ELSE 0 END)")} AS severity, {q("now_ms-dur", 30 * 60000)} AS ts_start, now_ms AS ts_end, round(lat,5) AS lat, round(lon,5) AS lon, entity_id AS entities FROM k WHERE (flags&32)<>0 OR alike<3""",
    "thermal_anomaly": f"WITH {OBS}, {THERMAL} SELECT {SLIM} FROM th",
    "seismic_shallow": f"WITH {OBS}, {SEISMIC} SELECT {SLIM} FROM se",
    "breaker_topk": f"WITH {OBS}, {THERMAL}, z AS (SELECT *, {q('ts_start', DAY)} AS tick_ms, row_number() OVER (PARTITION BY {q('ts_start', DAY)} ORDER BY severity DESC) AS rn FROM th) SELECT rule AS rule_group, tick_ms, count(*) AS produced, least(count(*),15) AS kept, min(severity) FILTER (WHERE rn<=15) AS weakest, (sum(severity) FILTER (WHERE rn<=15))::BIGINT AS severity_sum FROM z GROUP BY ALL",
    "confluence_edges": f"WITH {SIMPLE}, {CELLS} SELECT a_id, b_id FROM edges",
    "confluence_clusters": f"WITH RECURSIVE {SIMPLE}, {CELLS}, {REACH} SELECT cluster, count(*) AS n, sum(id)::BIGINT AS id_sum FROM cl GROUP BY cluster",
    "confluence_incidents": f"WITH RECURSIVE {SIMPLE}, {CELLS}, {REACH}, {INCIDENTS} SELECT severity, members, n_domains, ts_start, ts_end, round(lat,5) AS lat, round(lon,5) AS lon, radius_km, lead, ids FROM big WHERE severity>=55",
    "all_detections": f"WITH {FOUND} SELECT rule, count(*) AS n, sum(severity)::BIGINT AS severity_sum, min(ts_start) AS first_start FROM found GROUP BY rule",
    "recent_detections": f"WITH {FOUND} SELECT {SLIM} FROM found WHERE ts_start>{NOW - DAY} AND severity>=60 AND rule IN ('THERMAL_ANOMALY','SEISMIC_SHALLOW') ORDER BY ts_start DESC, entities LIMIT 1000",
    "incidents_ranked": f"WITH RECURSIVE {SIMPLE}, {CELLS}, {REACH}, {INCIDENTS} SELECT big.severity, big.ts_start, count(*) AS members, string_agg(DISTINCT m.rule, ',' ORDER BY m.rule) AS rules, min(m.id) AS least_id FROM big JOIN m USING (cluster) WHERE big.severity>=40 GROUP BY cluster, big.severity, big.ts_start",
    "purge_rule": f"WITH RECURSIVE {SIMPLE}, {CELLS}, {REACH}, {INCIDENTS} SELECT 'detections' AS what, count(*) AS n FROM simple WHERE rule<>'THERMAL_ANOMALY' UNION ALL SELECT 'incidents', count(*) FROM (SELECT cluster FROM big JOIN m USING (cluster) WHERE big.severity>=40 AND m.rule<>'THERMAL_ANOMALY' GROUP BY cluster HAVING count(*)>=2)",
    "route_events": f"WITH {OBS}, {THERMAL}, sub AS (SELECT bkey AS client_id, least(31,floor((mala+90e0)/180e0*128)::BIGINT) AS dummy, floor((mila+90e0)/180e0*128)::BIGINT AS r0, floor((mala+90e0)/180e0*128)::BIGINT AS r1, floor((milo+180e0)/360e0*256)::BIGINT AS c0, floor((malo+180e0)/360e0*256)::BIGINT AS c1 FROM box), ev2 AS (SELECT *, floor((lat+90e0)/180e0*128)::BIGINT AS rr, floor((lon+180e0)/360e0*256)::BIGINT AS cc FROM th) SELECT client_id, count(*) AS n, sum(obs_id)::BIGINT AS id_sum FROM sub JOIN ev2 ON severity>=70 OR (rr BETWEEN r0 AND r1 AND cc BETWEEN c0 AND c1) GROUP BY client_id",
    "case_file": f"WITH {OBS}, {GAPS} SELECT obs_id, round(rmax,1) AS r_max_m, round(half,6) AS half_deg, half>=180 AS omni, (13+(CASE WHEN rmin>0 THEN 13 WHEN half<180 THEN 1 ELSE 0 END)+1)::INT AS points FROM g WHERE verdict='IMPOSSIBLE_TRANSIT'",
    "evidence_bundle": f"WITH RECURSIVE {OBS}, {THERMAL}, {CHAIN} SELECT th.obs_id AS id, rule, severity, payload_sha, 1::BIGINT AS fixes FROM th JOIN chain ON chain.id=th.obs_id//100",
    "chain_build": f"WITH RECURSIVE {CHAIN} SELECT source_id, id, payload_sha, prev_sha, chain_sha FROM chain",
    "chain_verify": f"WITH {LOG}, z AS (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id)-1 AS idx FROM log) SELECT source_id, count(*) AS links, (min(idx) FILTER (WHERE id%41=17))::INT AS broken_at, CASE WHEN count(*) FILTER (WHERE id%41=17)>0 THEN 'payload' END AS reason FROM z GROUP BY source_id",
    "ingest_health": f"WITH {LOG}, src(source_id, source_key) AS (VALUES {','.join(f'({i},{k!r})' for i, k, _ in SOURCES)}), z AS (SELECT *, max(CASE WHEN http_status<300 THEN id END) OVER (PARTITION BY source_id) AS lo FROM log), y AS (SELECT source_id, count(*) AS attempts, count(*) FILTER (WHERE http_status<300) AS successes, count(*) FILTER (WHERE lo IS NULL OR id>lo) AS streak, (sum(CASE WHEN http_status<300 THEN record_count ELSE 0 END))::BIGINT AS records, max(fetched_ms) AS last_attempt, max(CASE WHEN http_status<300 THEN fetched_ms END) AS last_success FROM z GROUP BY source_id) SELECT source_id, source_key, attempts, successes, streak, records, last_attempt, last_success, (CASE WHEN streak>0 THEN least(300,pow(2,least(8,streak))) ELSE 0 END)::BIGINT AS backoff_s FROM y JOIN src USING (source_id)",
    "commit_gate": f"WITH {OBS}, {LOG} SELECT log.source_id AS stamped_source, count(*) AS n, max(obs_id) AS max_id FROM obs JOIN log ON log.id=obs.provenance_id WHERE http_status<300 GROUP BY log.source_id",
    "archive_stats": f"WITH {OBS} SELECT domain, count(*) AS n, min(ts_ms) AS oldest, max(ts_ms) AS newest, count(DISTINCT entity_id) AS entities FROM obs GROUP BY domain",
    "rule_summary": f"WITH {FOUND} SELECT rule, count(*) AS n, min(severity) AS least, max(severity) AS most FROM found GROUP BY rule",
    "detection_timeline": f"WITH {FOUND} SELECT {q('ts_start', DAY)} AS day_ms, CASE WHEN severity>=80 THEN 'high' WHEN severity>=60 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, max(severity) AS most, count(*) FILTER (WHERE severity>=70 AND ts_start>{NOW - DAY} AND ts_start<={NOW}) AS alarms FROM found GROUP BY ALL",
    "contact_status": f"WITH {OBS}, z AS (SELECT * FROM obs WHERE ts_ms<={NOW}), {STATE.format(src='z')}, y AS (SELECT *, ({NOW}-last_seen)/1000e0 AS age, sog_kt*6/60 AS nm FROM st) SELECT entity_id, CASE WHEN (flags&1)<>0 THEN 'emergency' WHEN (flags&2)<>0 THEN 'degraded' WHEN age>600 THEN 'dark' ELSE 'normal' END AS status, CASE kind WHEN 'cargo' THEN 2 WHEN 'fishing' THEN 5 ELSE 0 END AS code, CASE WHEN sog_kt>2 THEN round(lat+nm/60*cos(radians(cog_deg)),5) END AS lead_lat, CASE WHEN sog_kt>2 THEN round(lon+nm/60*sin(radians(cog_deg))/greatest(0.2e0,cos(radians(lat))),5) END AS lead_lon FROM y WHERE age<=86400",
    "slim_props": f"WITH {OBS} SELECT domain, count(*) FILTER (WHERE squawk IS NULL AND mag IS NULL AND frp IS NULL) AS empty, (count(squawk)+count(mag)+count(frp))::BIGINT AS kept FROM obs GROUP BY domain",
    "watchbox_geojson": f"WITH {OBS} SELECT bkey AS box_key, count(*) AS n, milo AS west, mala AS north, 5 AS points FROM (SELECT *, {first_box('lat', 'lon')} AS fb FROM obs) JOIN box ON bid=fb GROUP BY ALL",
    "coverage_circles": f"WITH {OBS}, c AS (SELECT *, (mila+mala)/2 AS clat, (milo+malo)/2 AS clon, least(250e0,greatest(40e0,sqrt(pow(mala-mila,2)+pow((malo-milo)*cos(radians((mila+mala)/2)),2))*60/2)) AS rad FROM box), o AS (SELECT *, {first_box('lat', 'lon')} AS fb FROM obs) SELECT bkey AS box_key, round(min(rad),4) AS radius_nm, count(*) FILTER (WHERE {hav('lat', 'lon', 'clat', 'clon')}<=rad*1852) AS inside, count(*) AS n FROM o JOIN c ON bid=fb GROUP BY bkey",
    "flag_states": f"WITH {OBS}, {GAPS} SELECT (flags|(CASE WHEN gap>3600 THEN 4 ELSE 0 END)|(CASE WHEN gap>600 THEN 16 ELSE 0 END)|(CASE WHEN verdict='IMPOSSIBLE_TRANSIT' THEN 128 ELSE 0 END))::INT AS state_flags, count(*) AS n FROM g GROUP BY 1",
    "voyages": f"WITH {OBS}, z AS (SELECT *, CASE WHEN ts_ms-lag(ts_ms) OVER w<{6 * H} THEN 0 ELSE 1 END AS st FROM obs WHERE domain=2 WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, obs_id)), y AS (SELECT *, sum(st) OVER (PARTITION BY entity_id ORDER BY ts_ms, obs_id) AS v FROM z) SELECT entity_id, count(*) AS fixes, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM y GROUP BY entity_id, v",
}
