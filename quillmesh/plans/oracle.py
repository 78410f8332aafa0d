"""DuckDB SQL for the registered queries. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

from math import exp

IMG = "img AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'Fire' ELSE 'No_Fire' END AS class FROM embeddings)"
TOX = "img AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Fire' ELSE 'No_Fire' END AS class FROM labels JOIN documents USING (doc_id))"
IID = "iid AS (SELECT id, class, 'node_' || chr(CAST(96 + ntile(3) OVER (PARTITION BY class ORDER BY md5('42:' || id), id) AS INT)) AS node FROM img)"


def skew(nodes: int) -> str:
    most = f"CAST(floor(per * {0.7 if nodes == 2 else 0.8}::DOUBLE) AS BIGINT)"
    between = "greatest(0, {})" if nodes > 2 else "{} + 1000000000"
    return f"""
sizes AS (SELECT count(*) FILTER (WHERE class = 'Fire') AS f, count(*) FILTER (WHERE class = 'No_Fire') AS o, count(*) // {nodes} AS per FROM img),
lean AS (SELECT *, least({most}, f) AS lean FROM sizes), back AS (SELECT *, least({most}, o - (per - lean)) AS back FROM lean),
lim AS (SELECT 'Fire' AS class, lean AS first, {between.format('f - lean - (per - back)')} AS middle FROM back UNION ALL SELECT 'No_Fire', per - lean, {between.format('o - (per - lean) - back')} FROM back),
rk AS (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY md5('skew:42:' || id), id) - 1 AS pos FROM img),
skew AS (SELECT id, class, CASE WHEN pos < first THEN 'node_a' WHEN pos < first + middle THEN 'node_b' ELSE 'node_c' END AS node FROM rk JOIN lim USING (class))"""


def split(source: str, name: str) -> str:
    return f"""{name} AS (SELECT id, class, node, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY node, class ORDER BY md5('split:42:' || id), id) - 1 AS pos, count(*) OVER (PARTITION BY node, class) AS n FROM {source}))"""


MET = "met AS (SELECT l_suppkey % 3 AS node, l_linenumber AS round, l_quantity AS n, 1 - l_discount AS accuracy, l_tax AS loss FROM lineitem)"
PAR = """par AS (SELECT printf('%08d', vec_id) AS node, label + 1 AS n, (i - 1) // 8 AS layer, (i - 1) % 8 AS pos, embedding[i]::DOUBLE AS value
FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""
AVG = "avgw AS (SELECT layer, pos, sum(n * value) / sum(n) AS value FROM par GROUP BY ALL)"
PLACED = f"{IMG}, {IID}, {split('iid', 'sp')}, placed AS (SELECT sp.id, node, split, label, embedding::DOUBLE[] AS x FROM sp JOIN embeddings ON vec_id = sp.id)"
PIX = "pix AS (SELECT node, split, label, i - 1 AS pos, x[i] AS value FROM (SELECT *, unnest(generate_series(1, len(x))) AS i FROM placed))"
LOC = "loc AS (SELECT node, label, pos, avg(value) AS value, count(*) AS n FROM pix WHERE split = 'train' GROUP BY ALL)"
GLO = "glo AS (SELECT label, pos, sum(n * value) / sum(n) AS value FROM loc GROUP BY ALL)"


def nearest(model: str, split_name: str, key: str = "") -> str:
    """Predictions of each sample of a split by ``model`` (key, label, pos, value)."""
    k = f"{key}, " if key else ""
    return f"""pt AS (SELECT id, node, label, i - 1 AS pos, x[i] AS v FROM (SELECT *, unnest(generate_series(1, len(x))) AS i FROM placed WHERE split = '{split_name}')),
dist AS (SELECT {k} pt.id, pt.node, pt.label, m.label AS cand, sum((m.value - v) * (m.value - v)) AS d FROM pt JOIN {model} m USING (pos) GROUP BY ALL),
pred AS (SELECT {k} id, node, label, arg_min(cand, struct_pack(d := d, cand := cand)) AS pred FROM dist GROUP BY ALL)"""


LOG = """ek AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
lines AS (SELECT event_id, ts, concat('RAM ', 1000 + k * 10, '/7620MB SWAP ', k, '/3810MB CPU [', k % 100, '%@1510,', CASE WHEN k % 3 = 0 THEN 'off' ELSE concat(k % 50, '%@1344') END, ',0%@729] GR3D_FREQ ', k % 100,
  '% cpu@', 40 + k % 20, '.5C gpu@', 38 + k % 20, '.0C soc2@41.5C tj@', 42 + k % 20, '.5C GPU ', 1000 + k * 3, '/', 1000 + k * 2, ' CPU ', 500 + k, '/500',
  CASE WHEN k % 2 = 0 THEN concat(' SOC ', 700 + k, '/700') ELSE '' END) AS value FROM ek)"""


def field(pattern: str, group: int, kind: str) -> str:
    return f"TRY_CAST(regexp_extract(value, '{pattern}', {group}) AS {kind})"


PARSED = f"""{LOG}, p AS (SELECT event_id, ts, value, {field('RAM\\s+(\\d+)/(\\d+)MB', 1, 'INT')} AS ram_used_mb, {field('RAM\\s+(\\d+)/(\\d+)MB', 2, 'INT')} AS ram_total_mb, {field('SWAP\\s+(\\d+)/(\\d+)MB', 1, 'INT')} AS swap_used_mb,
  {field('GR3D_FREQ\\s+(\\d+)%', 1, 'INT')} AS gpu_freq_percent, {field('\\bGPU\\s+(\\d+)/(\\d+)\\b', 1, 'INT')} AS power_gpu_mw, {field('\\bGPU\\s+(\\d+)/(\\d+)\\b', 2, 'INT')} AS power_gpu_avg_mw,
  {field('\\bCPU\\s+(\\d+)/(\\d+)\\b', 1, 'INT')} AS power_cpu_mw, {field('\\bSOC\\s+(\\d+)/(\\d+)\\b', 1, 'INT')} AS power_soc_mw, {field('\\bCV\\s+(\\d+)/(\\d+)\\b', 1, 'INT')} AS power_cv_mw,
  {field('cpu@([\\d.]+)C', 1, 'DOUBLE')} AS temp_cpu_c, {field('gpu@([\\d.]+)C', 1, 'DOUBLE')} AS temp_gpu_c, {field('soc2@([\\d.]+)C', 1, 'DOUBLE')} AS temp_soc_c, {field('tj@([\\d.]+)C', 1, 'DOUBLE')} AS temp_tj_c FROM lines),
tot AS (SELECT *, coalesce(power_gpu_mw, 0) + coalesce(power_cpu_mw, 0) + coalesce(power_soc_mw, 0) AS mw FROM p)"""
FRAMES = """fe AS (SELECT date_trunc('hour', ts) AS frame, CASE WHEN event_type IN ('view', 'purchase') THEN 'color' WHEN event_type IN ('click', 'signup') THEN 'depth' WHEN event_type = 'error' THEN 'ir' END AS stream, ts FROM events),
fr AS (SELECT frame, min(ts) FILTER (WHERE stream = 'color') AS color_ts, min(ts) FILTER (WHERE stream = 'depth') AS depth_ts, min(ts) FILTER (WHERE stream = 'ir') AS ir_ts, count(*) AS n_events
  FROM fe WHERE stream IS NOT NULL GROUP BY frame HAVING count(DISTINCT stream) = 3)"""
RUNS = """runs AS (SELECT o_orderpriority AS run, o_custkey % 3 AS seed, (month(o_orderdate) - 1) % 3 + 1 AS round, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS accuracy, avg(o_totalprice) / 60 AS minutes
  FROM orders GROUP BY ALL)"""


def r(x: str, digits: int = 6) -> str:
    return f"round_even({x}, {digits})"


POWER = f"""count(*) AS num_samples, {r('count(*) * (100 / 1000.0)::DOUBLE', 2)} AS duration_s, {r('max(mw / 1000.0::DOUBLE)', 3)} AS power_max_w, {r('avg(mw / 1000.0::DOUBLE)', 3)} AS power_avg_w"""

MESSAGES = """vx AS (SELECT vec_id % 3 AS node, vec_id // 3 % 3 + 1 AS round, i - 1 AS place, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
msg AS (SELECT node, round, place, avg(v) AS moved, count(*) AS n FROM vx GROUP BY ALL), giv AS (SELECT round, place, avg(v) AS given FROM vx GROUP BY ALL),
init AS (SELECT vec_id AS node, i - 1 AS place, embedding[i]::DOUBLE AS w FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE vec_id < 3))"""


def rounds(mu: float = 0.0, keep: str = "FALSE", node: str = "node", n_rounds: int = 3, epochs: int = 2, batches: int = 2, rate: float = 0.5) -> str:
    """Softmax regression by gradient steps, written out: each step, average and score is a table. ``keep`` says which of (layer) stays local."""
    step, out, last = 0, [], "w0"
    ctes = [
        PLACED,
        f"px AS MATERIALIZED (SELECT id, {node} AS node, split, label, CAST('0x' || md5('order:' || id)[1:4] AS INT) % {batches} AS batch, i - 1 AS pos, CASE WHEN i > 64 THEN 1.0::DOUBLE ELSE x[i] END AS v, i > 64 AS layer FROM (SELECT *, unnest(generate_series(1, 65)) AS i FROM placed))",
        "w0 AS MATERIALIZED (SELECT node, class, pos, layer, 0.0::DOUBLE AS w FROM (SELECT DISTINCT node, pos, layer FROM px WHERE split = 'train'), range(10) c(class))",
        "clients AS MATERIALIZED (SELECT node, count(DISTINCT id) AS n FROM px WHERE split = 'train' GROUP BY node)",
    ]

    def scored(name: str, model: str, where: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT *, z - max(z) OVER (PARTITION BY id) - ln(sum(exp(z - top)) OVER (PARTITION BY id)) AS lp FROM (
          SELECT *, max(z) OVER (PARTITION BY id) AS top FROM (SELECT px.id, px.node, px.label, m.class, sum(m.w * px.v) AS z FROM px JOIN {model} m ON m.node = px.node AND m.pos = px.pos WHERE {where} GROUP BY ALL)))"""

    for k in range(1, n_rounds + 1):
        start, losses = last, []
        for at in range(epochs * batches):
            step += 1
            s, before = f"s{step}", last
            ctes.append(scored(s, before, f"split = 'train' AND batch = {at % batches}"))
            ctes.append(f"n{step} AS MATERIALIZED (SELECT node, count(DISTINCT id) AS n FROM {s} GROUP BY node)")
            ctes.append(f"g{step} AS MATERIALIZED (SELECT px.node, class, pos, sum((exp(lp) - CASE WHEN class = px.label THEN 1 ELSE 0 END) * v) AS g FROM {s} JOIN px USING (id, node) GROUP BY ALL)")
            ctes.append(f"""l{step} AS MATERIALIZED (SELECT n{step}.node, n, (SELECT sum(-lp) FROM {s} WHERE class = label AND {s}.node = n{step}.node)
              + n * {mu / 2}::DOUBLE * (SELECT sum(pow(b.w - a.w, 2)) FROM {before} b JOIN {start} a USING (node, class, pos) WHERE b.node = n{step}.node) AS loss FROM n{step})""")
            last = f"w{step}"
            ctes.append(f"""{last} AS MATERIALIZED (SELECT b.node, b.class, b.pos, b.layer, CASE WHEN n IS NULL THEN b.w ELSE b.w - {rate}::DOUBLE * (g / n + {mu}::DOUBLE * (b.w - a.w)) END AS w
              FROM {before} b JOIN {start} a USING (node, class, pos) LEFT JOIN g{step} USING (node, class, pos) LEFT JOIN n{step} ON n{step}.node = b.node)""")
            losses.append(f"SELECT * FROM l{step}")
        ctes.append(f"t{k} AS MATERIALIZED (SELECT node, sum(loss) / sum(n) AS train_loss FROM ({' UNION ALL '.join(losses)}) GROUP BY node)")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT class, pos, sum(n * w) / sum(n) AS w FROM {last} JOIN clients USING (node) GROUP BY class, pos)")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT m.node, m.class, m.pos, layer, CASE WHEN {keep} THEN m.w ELSE a{k}.w END AS w FROM {last} m JOIN a{k} USING (class, pos))")
        last = f"r{k}"
        ctes.append(scored(f"v{k}", last, "split = 'val'"))
        out.append(f"""SELECT {k} AS round, node, count(*) AS num_examples, {r('any_value(train_loss)')} AS train_loss, {r('avg(-lp)')} AS loss, {r('avg(CASE WHEN best = label THEN 1.0 ELSE 0.0 END)')} AS accuracy
          FROM (SELECT id, node, label, max(lp) FILTER (WHERE class = label) AS lp, arg_max(class, z - class * 1e-13) AS best FROM v{k} GROUP BY ALL) JOIN t{k} USING (node) GROUP BY node""")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


def poisson(u: str) -> str:
    """Poisson(1) by inversion, up to 8."""
    below, term, parts = 0.0, exp(-1), []
    for k in range(8):
        below, term = below + term, term / (k + 1)
        parts.append(f"CASE WHEN {u} >= {below!r}::DOUBLE THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def field_of(text: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({text}, '{pattern}', {group}) AS INT)"


def local_epochs(mu: float = 0.1, n_rounds: int = 2, epochs: int = 2, batch: int = 64, steps: int = 8, rate: float = 0.05) -> str:
    """Local epochs with Adam, written out: each step is a table. For nodes of up to ``batch * steps`` training samples."""
    step, out, last = 0, [], "w0"
    ctes = [
        PLACED,
        "px AS MATERIALIZED (SELECT id, node, split, label, i - 1 AS pos, CASE WHEN i > 64 THEN 1.0::DOUBLE ELSE x[i] END AS v, i > 64 AS layer FROM (SELECT *, unnest(generate_series(1, 65)) AS i FROM placed))",
        "w0 AS MATERIALIZED (SELECT node, class, pos, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT DISTINCT node, pos FROM px WHERE split = 'train'), range(10) c(class))",
        "clients AS MATERIALIZED (SELECT node, count(DISTINCT id) AS n FROM px WHERE split = 'train' GROUP BY node)",
    ]

    def scored(name: str, model: str, rows: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT *, z - top - ln(sum(exp(z - top)) OVER (PARTITION BY id)) AS lp FROM (
          SELECT *, max(z) OVER (PARTITION BY id) AS top FROM (SELECT px.id, px.node, px.label, m.class, sum(m.w * px.v) AS z FROM px JOIN {model} m ON m.node = px.node AND m.pos = px.pos WHERE px.id IN ({rows}) GROUP BY ALL)))"""

    for k in range(1, n_rounds + 1):
        start, losses = last, []
        for e in range(epochs):
            deal = f"d{k}_{e}"
            ctes.append(f"{deal} AS MATERIALIZED (SELECT id, node, (row_number() OVER (PARTITION BY node ORDER BY md5('42:{k}:{e}:' || md5('order:' || id))) - 1) // {batch} AS b FROM placed WHERE split = 'train')")
            for at in range(steps):
                step += 1
                s, before = f"s{step}", last
                ctes.append(scored(s, before, f"SELECT id FROM {deal} WHERE b = {at}"))
                ctes.append(f"n{step} AS MATERIALIZED (SELECT c.node, count(DISTINCT id) AS n, any_value({e} * ceil(c.n / {batch}) + {at} + 1) AS t FROM {s} JOIN clients c USING (node) GROUP BY c.node)")
                ctes.append(f"g{step} AS MATERIALIZED (SELECT px.node, class, pos, sum((exp(lp) - CASE WHEN class = px.label THEN 1 ELSE 0 END) * v) AS g FROM {s} JOIN px USING (id, node) GROUP BY ALL)")
                ctes.append(f"""l{step} AS MATERIALIZED (SELECT n{step}.node, n, (SELECT sum(-lp) FROM {s} WHERE class = label AND {s}.node = n{step}.node)
                  + n * {mu / 2}::DOUBLE * (SELECT sum(pow(b.w - a.w, 2)) FROM {before} b JOIN {start} a USING (node, class, pos) WHERE b.node = n{step}.node) AS loss FROM n{step})""")
                last = f"w{step}"
                ctes.append(f"""{last} AS MATERIALIZED (SELECT node, class, pos, CASE WHEN n IS NULL THEN w ELSE w - {rate}::DOUBLE * (m2 / (1 - pow(0.9::DOUBLE, t))) / (sqrt(v2 / (1 - pow(0.999::DOUBLE, t))) + 1e-8::DOUBLE) END AS w,
                  coalesce(m2, m) AS m, coalesce(v2, v) AS v FROM (SELECT *, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * d AS m2, 0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * d * d AS v2 FROM (
                  SELECT b.*, n, t, g / n + {mu}::DOUBLE * (b.w - a.w) AS d FROM {before} b JOIN {start} a USING (node, class, pos) LEFT JOIN g{step} USING (node, class, pos) LEFT JOIN n{step} ON n{step}.node = b.node)))""")
                losses.append(f"SELECT * FROM l{step}")
        ctes.append(f"t{k} AS MATERIALIZED (SELECT node, sum(loss) / sum(n) AS train_loss FROM ({' UNION ALL '.join(losses)}) GROUP BY node)")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT class, pos, sum(n * w) / sum(n) AS w FROM {last} JOIN clients USING (node) GROUP BY class, pos)")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT m.node, m.class, m.pos, a{k}.w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM {last} m JOIN a{k} USING (class, pos))")
        last = f"r{k}"
        ctes.append(scored(f"v{k}", last, "SELECT id FROM placed WHERE split = 'val'"))
        out.append(f"""SELECT {k} AS round, node, count(*) AS num_examples, {r('any_value(train_loss)')} AS train_loss, {r('avg(-lp)')} AS loss, {r('avg(CASE WHEN best = label THEN 1.0 ELSE 0.0 END)')} AS accuracy
          FROM (SELECT id, node, label, max(lp) FILTER (WHERE class = label) AS lp, arg_max(class, z - class * 1e-13) AS best FROM v{k} GROUP BY ALL) JOIN t{k} USING (node) GROUP BY node""")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


SQL = {
    "q01_image_inventory": f"WITH {TOX} SELECT c.class, count(id) AS n FROM (VALUES ('Fire'), ('No_Fire')) c(class) LEFT JOIN img USING (class) GROUP BY c.class",
    "q02_iid_partition": f"WITH {IMG}, {IID} SELECT id, class, node FROM iid",
    "q03_split_stats_iid": f"""WITH {IMG}, {IID}, {split('iid', 'sp')}, c AS (SELECT node, split, count(*) FILTER (WHERE class = 'Fire') AS fire, count(*) FILTER (WHERE class = 'No_Fire') AS nofire FROM sp GROUP BY ALL)
      SELECT 'iid' AS dist, node, split, fire, nofire, fire + nofire AS total, {r('fire / greatest(fire + nofire, 1)', 3)} AS fire_ratio FROM c""",
    "q04_noniid_partition_2": f"WITH {IMG}, {skew(2)} SELECT id, class, node FROM skew",
    "q05_noniid_partition_3": f"WITH {IMG}, {skew(3)} SELECT id, class, node FROM skew",
    "q06_noniid_toxic_clamped": f"WITH {TOX}, {skew(3)} SELECT node, class, count(*) AS n FROM skew GROUP BY ALL",
    "q07_split_rollup": f"""WITH {IMG}, {IID}, {split('iid', 'a')}, {skew(3)}, {split('skew', 'b')}, u AS (SELECT 'iid' AS dist, * FROM a UNION ALL SELECT 'non_iid', * FROM b)
      SELECT dist, node, split, count(*) AS n, CAST(grouping(dist, node, split) AS BIGINT) AS level FROM u GROUP BY ROLLUP (dist, node, split)""",
    "q08_split_leak_check": f"""WITH {IMG}, {IID}, {split('iid', 'sp')} SELECT (SELECT count(*) FROM (SELECT id FROM sp WHERE split = 'train' INTERSECT SELECT id FROM sp WHERE split = 'test')) AS n_leaked,
      count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM sp""",
    "q09_weighted_accuracy": f"WITH {MET} SELECT round, {r('sum(n * accuracy) / sum(n)')} AS accuracy, {r('sum(n * loss) / sum(n)')} AS loss, sum(n) AS num_examples FROM met GROUP BY round",
    "q10_positional_rounds": f"""WITH {MET}, g AS (SELECT round, sum(n * loss) / sum(n) AS loss FROM met GROUP BY round HAVING count(DISTINCT node) >= 3)
      SELECT round, row_number() OVER (ORDER BY round) AS position, {r('loss')} AS loss FROM g""",
    "q11_epoch_loss_partial": f"WITH {MET} SELECT node, {r('sum(n * loss) / greatest(sum(n), 1)')} AS epoch_loss FROM met GROUP BY node",
    "q12_eval_argmax": f"""WITH e AS (SELECT label, (list_position(embedding, list_max(embedding)) - 1) % 10 AS pred FROM embeddings)
      SELECT count(*) AS num_examples, count(*) FILTER (WHERE pred = label) AS correct, {r('count(*) FILTER (WHERE pred = label) / count(*)')} AS accuracy FROM e""",
    "q12b_cross_entropy": f"""WITH e AS (SELECT label AS y, embedding::DOUBLE[] AS z FROM embeddings)
      SELECT y, {r('avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[y + 1])')} AS loss, count(*) AS n FROM e GROUP BY y""",
    "q13_node_mean_unweighted": f"WITH {MET}, g AS (SELECT node, avg(accuracy) AS a FROM met GROUP BY node) SELECT {r('avg(a)')} AS mean_accuracy, count(*) AS n_nodes FROM g",
    "q14_fedavg_arrays": f"WITH {PAR}, {AVG} SELECT layer, pos, {r('value')} AS value FROM avgw",
    "q15_fedbn_arrays": f"""WITH {PAR} SELECT layer, pos, {r('sum(n * value) / sum(n)')} AS value FROM par WHERE layer % 2 = 0 GROUP BY layer, pos
      UNION ALL SELECT layer, pos, {r('arg_min(value, node)')} AS value FROM par WHERE layer % 2 = 1 GROUP BY layer, pos""",
    "q16_prox_term": f"WITH {PAR}, {AVG} SELECT node, {r('0.005::DOUBLE * sum((p.value - a.value) * (p.value - a.value))')} AS prox FROM par p JOIN avgw a USING (layer, pos) GROUP BY node",
    "q17_bn_semi": f"WITH {PAR} SELECT layer, count(DISTINCT node) AS n FROM par WHERE layer % 2 = 1 GROUP BY layer",
    "q17b_bn_anti": f"WITH {PAR} SELECT layer, count(DISTINCT node) AS n FROM par WHERE layer % 2 = 0 GROUP BY layer",
    "q18_load_keep_local": f"WITH {PAR}, {AVG} SELECT node, layer, {r('sum(CASE WHEN layer % 2 = 1 THEN p.value ELSE a.value END)')} AS total FROM par p JOIN avgw a USING (layer, pos) GROUP BY node, layer",
    "q19_param_size": f"WITH {PAR} SELECT count(*) AS n_params, count(*) * 4 / 1e6 AS size_mb FROM par",
    "q20_channel_widen": f"""SELECT vec_id, i - 1 AS channel, {r('CASE WHEN i <= 64 THEN embedding[i]::DOUBLE ELSE list_avg(embedding::DOUBLE[]) END')} AS value
      FROM (SELECT *, unnest(generate_series(1, 66)) AS i FROM embeddings)""",
    "q21_local_centroids": f"WITH {PLACED}, {PIX}, {LOC} SELECT node, label, pos, {r('value')} AS value, n FROM loc",
    "q22_fedavg_centroid_round": f"""WITH {PLACED}, {PIX}, {LOC}, {GLO}, {nearest('glo', 'val')} SELECT coalesce(node, 'all') AS node, count(*) AS num_examples, count(*) FILTER (WHERE pred = label) AS correct,
      {r('count(*) FILTER (WHERE pred = label) / count(*)')} AS accuracy FROM pred GROUP BY ROLLUP (node)""",
    "q23_fedprox_centroid": f"""WITH {PLACED}, {PIX}, {LOC}, {GLO}, mus AS (SELECT unnest([0.0, 0.01, 0.1])::DOUBLE AS mu)
      SELECT mu, node, {r('sum(pow((l.value + mu * g.value) / (1 + mu), 2))')} AS norm2 FROM loc l JOIN glo g USING (label, pos), mus GROUP BY mu, node""",
    "q24_centralized_centroid": f"""WITH {PLACED}, {PIX}, cen AS (SELECT label, pos, avg(value) AS value FROM pix WHERE split = 'train' GROUP BY ALL), {nearest('cen', 'test')}
      SELECT coalesce(node, 'all') AS node, count(*) AS num_examples, count(*) FILTER (WHERE pred = label) AS correct FROM pred GROUP BY ROLLUP (node)""",
    "q25_cross_eval": f"""WITH {PLACED}, {PIX}, {LOC}, loc2 AS (SELECT node AS train_node, label, pos, value FROM loc), {nearest('loc2', 'test', 'train_node')}
      SELECT train_node, node AS test_node, count(*) AS num_examples, count(*) FILTER (WHERE pred = label) AS correct FROM pred WHERE train_node <> node GROUP BY ALL""",
    "q26_power_parse": f"WITH {PARSED} SELECT event_id, ram_used_mb, ram_total_mb, swap_used_mb, gpu_freq_percent, power_gpu_mw, power_gpu_avg_mw, power_cpu_mw, power_soc_mw, power_cv_mw, temp_cpu_c, temp_gpu_c, temp_soc_c, temp_tj_c FROM p",
    "q27_power_cores": f"""WITH {LOG}, c AS (SELECT event_id, trim(unnest(string_split(regexp_extract(value, 'CPU\\s+\\[([^\\]]+)\\]', 1), ','))) AS core FROM lines),
      v AS (SELECT event_id, coalesce(TRY_CAST(regexp_extract(core, '^(\\d+)%@(\\d+)', 1) AS INT), 0) AS u, coalesce(TRY_CAST(regexp_extract(core, '^(\\d+)%@(\\d+)', 2) AS INT), 0) AS f FROM c)
      SELECT event_id, {r('avg(u)')} AS usage, {r('avg(f)')} AS freq, count(*) FILTER (WHERE u > 0) AS active FROM v GROUP BY event_id""",
    "q28_power_total": f"WITH {PARSED} SELECT event_id, CAST(mw AS BIGINT) AS total_mw, mw / 1000.0::DOUBLE AS power_total_w FROM tot",
    "q29_power_summary": f"""WITH {PARSED}, a AS (SELECT {POWER}, {r('min(mw / 1000.0::DOUBLE)', 3)} AS power_min_w, {r('max(power_gpu_mw / 1000.0::DOUBLE)', 3)} AS gpu_power_max_w, max(ram_used_mb) AS ram_peak_mb,
      {r('stddev_samp(mw / 1000.0::DOUBLE)', 3)} AS power_std_w, {r('max(temp_cpu_c)', 1)} AS temp_cpu_c_max FROM tot)
      SELECT num_samples, duration_s, power_max_w, power_min_w, gpu_power_max_w, ram_peak_mb, power_avg_w, {r('power_avg_w * (num_samples * 0.1::DOUBLE) / 3600', 4)} AS energy_total_wh, power_std_w, temp_cpu_c_max FROM a""",
    "q30_power_by_round": f"""WITH {PARSED} SELECT CAST(dayofyear(ts) AS INT) AS round, {POWER}, 86400.0::DOUBLE AS wall_s FROM tot GROUP BY dayofyear(ts)""",
    "q31_power_line_numbers": f"WITH {LOG} SELECT strftime(ts, '%Y-%m-%d') AS log, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS line_num, md5(value) AS line_md5 FROM lines",
    "q32_frame_complete": f"WITH {FRAMES} SELECT * FROM fr",
    "q33_frame_warmup": f"WITH {FRAMES}, n AS (SELECT frame, row_number() OVER (ORDER BY frame) AS n FROM fr) SELECT frame, lpad(CAST(n - 31 AS VARCHAR), 5, '0') AS frame_id FROM n WHERE n BETWEEN 31 AND 130",
    "q34_depth_stats": f"""SELECT event_type, {r('coalesce(min(value - 10) FILTER (WHERE value - 10 > 0), 0.0)')} AS depth_min, {r('coalesce(max(value - 10) FILTER (WHERE value - 10 > 0), 0.0)')} AS depth_max,
      {r("count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)")} AS fps FROM events GROUP BY event_type""",
    "q35_frame_metadata_json": """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
      SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS frame_id, k, '{"fx":' || k || ',"fy":' || k * 2 || '}' AS intrinsics FROM e""",
    "q36_experiment_matrix": """WITH o AS (SELECT o_orderpriority AS strategy, o_orderstatus AS dist, o_custkey % 3 AS seed, o_totalprice FROM orders)
      SELECT * FROM (SELECT DISTINCT strategy FROM o), (SELECT DISTINCT dist FROM o), (SELECT DISTINCT seed FROM o) EXCEPT SELECT strategy, dist, seed FROM o WHERE o_totalprice > 499000""",
    "q37_fl_round_equivalents": f"""WITH {MET}, g AS (SELECT node, round * 5 AS epoch, avg(loss) AS loss FROM met GROUP BY ALL)
      SELECT node, {r('max(loss) FILTER (WHERE epoch = 5)')} AS epoch_5, {r('max(loss) FILTER (WHERE epoch = 10)')} AS epoch_10, {r('max(loss) FILTER (WHERE epoch = 15)')} AS epoch_15, {r('max(loss) FILTER (WHERE epoch = 50)')} AS epoch_50 FROM g GROUP BY node""",
    "q38_convergence_table": f"""WITH {RUNS}, g AS (SELECT run, round, avg(accuracy) AS a FROM runs GROUP BY ALL), t AS (SELECT run, max(a) FILTER (WHERE round = 1) AS r1, max(a) FILTER (WHERE round = 2) AS r2, max(a) FILTER (WHERE round = 3) AS r3,
      arg_min(a, round) AS f, arg_max(a, round) AS l FROM g GROUP BY run) SELECT run, {r('r1')} AS r1, {r('r2')} AS r2, {r('r3')} AS r3, {r('f')} AS first_acc, {r('l')} AS last_acc, {r('l - f')} AS gain FROM t""",
    "q39_findings": f"""WITH {RUNS}, f AS (SELECT run, avg(accuracy) AS a, avg(minutes) AS m FROM runs WHERE round = 3 GROUP BY run)
      SELECT x.run AS run_a, y.run AS run_b, {r('(x.a - y.a) * 100')} AS diff_pp, {r('x.m - y.m')} AS diff_minutes FROM f x JOIN f y ON x.run < y.run""",
    "q40_mean_std_over_seeds": f"""WITH {RUNS} SELECT run, count(*) AS n, {r('avg(accuracy)')} AS mean, {r('stddev_samp(accuracy)')} AS std, {r('4.303::DOUBLE * stddev_samp(accuracy) / sqrt(count(*))')} AS ci95 FROM runs WHERE round = 3 GROUP BY run""",
    "q43_stream_tumbling": f"""WITH e AS (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events)
      SELECT start, event_type, count(*) AS n, {r('sum(value)')} AS total FROM e GROUP BY start, event_type""",
    "q44_stream_sliding": f"""WITH e AS (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type, value FROM events)
      SELECT start, event_type, count(*) AS n, {r('sum(value)')} AS total FROM e GROUP BY ALL""",
    "q45_stream_session": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM i GROUP BY user_id, island""",
    "q46_stream_stateful": f"SELECT event_type, count(*) AS n, {r('avg(value)')} AS mean FROM events GROUP BY event_type",
    "q47_friedman_ranks": f"""WITH {RUNS}, k AS (SELECT run, rank() OVER (PARTITION BY seed ORDER BY accuracy DESC) AS r FROM runs WHERE round = 3), m AS (SELECT run, avg(r) AS mean_rank, count(*) AS n FROM k GROUP BY run),
      s AS (SELECT count(*) AS k, max(n) AS n, sum(mean_rank * mean_rank) AS q FROM m)
      SELECT run, {r('mean_rank')} AS mean_rank, {r('12.0::DOUBLE * s.n / (k * (k + 1)) * (q - k * (k + 1) * (k + 1) / 4.0::DOUBLE)')} AS statistic FROM m, s""",
    "q48_cohens_d": f"""WITH {RUNS}, m AS (SELECT run, count(*) AS n, avg(accuracy) AS m, var_samp(accuracy) AS v FROM runs WHERE round = 3 GROUP BY run)
      SELECT a.run AS run_a, b.run AS run_b, {r('(a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 0)')} AS d FROM m a JOIN m b ON a.run < b.run""",
    "q49_transfer_time": f"""WITH t AS (SELECT l_returnflag, l_extendedprice * 8 / nullif(l_quantity * 1e6 * (1 - l_discount), 0) AS s FROM lineitem) SELECT l_returnflag, {r('avg(s)')} AS mean_seconds, {r('max(s)')} AS max_seconds FROM t GROUP BY 1""",
    "q50_modality_channels": f"""WITH e AS (SELECT m.modality, list_sum(embedding[lo:hi]::DOUBLE[]) AS t, hi - lo + 1 AS c FROM embeddings, (VALUES ('rgb', 1, 48), ('depth', 49, 56), ('ir', 57, 64)) m(modality, lo, hi))
      SELECT modality, CAST(sum(c) AS BIGINT) AS channels, {r('avg(t)')} AS mean_total FROM e GROUP BY modality""",
    "q51_as_of_join": """WITH v AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
      SELECT p.event_id, p.user_id, v.seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "q52_cube_and_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "q53_round_change": f"""WITH {MET}, g AS (SELECT node, round, sum(n * loss) / sum(n) AS loss, sum(n * accuracy) / sum(n) AS accuracy FROM met GROUP BY ALL)
      SELECT node, round, {r('loss - lag(loss) OVER (PARTITION BY node ORDER BY round)')} AS change, {r('avg(accuracy) OVER (PARTITION BY node ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS moving FROM g""",
    "q54_full_outer_nodes": """WITH c AS (SELECT c_nationkey AS nation, count(*) AS clients FROM customer GROUP BY 1), p AS (SELECT s_nationkey AS nation, count(*) AS servers FROM supplier GROUP BY 1)
      SELECT nation, clients, servers FROM c FULL OUTER JOIN p USING (nation)""",
    "q46b_stream_frames": f"WITH {FRAMES} SELECT frame AS start, n_events FROM fr",
    "q55_normalised_channels": f"""WITH e AS (SELECT vec_id, [0.485, 0.456, 0.406][label % 3 + 1]::DOUBLE AS m, [0.229, 0.224, 0.225][label % 3 + 1]::DOUBLE AS s, unnest(embedding)::DOUBLE AS v FROM embeddings)
      SELECT vec_id, {r('sum((v / 255.0::DOUBLE - m) / s)')} AS total FROM e GROUP BY vec_id""",
    "q56_results_document": f"WITH {RUNS} SELECT run, row_number() OVER (PARTITION BY run ORDER BY round) AS position, {r('avg(minutes)')} AS loss FROM runs GROUP BY run, round",
    "q57_nested_statistics": f"WITH {IMG}, {IID}, {split('iid', 'sp')} SELECT node, split, count(*) AS total FROM sp GROUP BY ALL",
    "q41_softmax_fedavg": rounds(),
    "q42_softmax_fedprox": rounds(mu=0.1),
    "q42b_softmax_fedbn": rounds(keep="layer"),
    "q41b_softmax_centralized": rounds(node="'all'"),
    "q41c_softmax_local_only": rounds(keep="TRUE"),
    "q58_time_and_accuracy": f"WITH {RUNS} SELECT run, seed, {r('arg_max(accuracy, round)')} AS accuracy, {r('arg_max(minutes, round)')} AS minutes FROM runs GROUP BY run, seed",
    "q59_nodes_side_by_side": f"""WITH {RUNS}, f AS (SELECT run, seed, arg_max(accuracy, round) AS a FROM runs GROUP BY run, seed)
      SELECT run, {r('any_value(a) FILTER (WHERE seed = 0)')} AS seed_0, {r('any_value(a) FILTER (WHERE seed = 1)')} AS seed_1, {r('any_value(a) FILTER (WHERE seed = 2)')} AS seed_2 FROM f GROUP BY run""",
    "q60_named_findings": f"""WITH {RUNS}, f AS (SELECT run, round, avg(accuracy) AS a, avg(minutes) AS m FROM runs GROUP BY run, round),
      n(finding, x, i, y, j, measure) AS (VALUES ('first_round_gap', '1-URGENT', 1, '2-HIGH', 1, 'a'), ('first_round_gain', '3-MEDIUM', 1, '2-HIGH', 1, 'a'), ('scale_even', '1-URGENT', 1, '5-LOW', 1, 'a'),
        ('scale_skewed', '2-HIGH', 1, '4-NOT SPECIFIED', 1, 'a'), ('last_round_gap', '1-URGENT', 3, '2-HIGH', 3, 'a'), ('recovered', '2-HIGH', 3, '2-HIGH', 1, 'a'), ('overhead', '3-MEDIUM', 3, '2-HIGH', 3, 'm'))
      SELECT finding, {r("CASE measure WHEN 'a' THEN (p.a - q.a) * 100 ELSE p.m - q.m END")} AS value FROM n LEFT JOIN f p ON p.run = x AND p.round = i LEFT JOIN f q ON q.run = y AND q.round = j""",
    "q61_unique_names": """WITH p AS (SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS host, url FROM pages)
      SELECT host, string_split(url, '/')[-1] AS base_name, max(url) AS url FROM p WHERE host <> '' GROUP BY ALL""",
    "q62_baseline_document": f"""WITH {RUNS}, f AS (SELECT run, seed, arg_max(accuracy, round) AS a, arg_max(minutes, round) AS m FROM runs GROUP BY run, seed)
      SELECT run AS experiment, {r('sum(m) OVER (PARTITION BY run) * 60', 1)} AS total_time_s, {r('avg(a) OVER (PARTITION BY run)')} AS mean_test_accuracy, 'node_' || chr(CAST(97 + seed AS INT)) AS node,
        {r('a')} AS final_test_accuracy, {r('m * 60', 1)} AS node_time_s FROM f""",
    "q63_stream_client_state": f"""WITH {MESSAGES} SELECT node, CAST(place // 8 AS INT) AS layer, CAST(place % 8 AS INT) AS pos,
      {r("CASE WHEN place // 8 % 2 = 1 THEN any_value(w) + sum(moved) ELSE arg_max(given + moved, round) END")} AS value FROM msg JOIN giv USING (round, place) JOIN init USING (node, place) GROUP BY node, place""",
    "q64_stream_rounds": f"""WITH {MESSAGES}, a AS (SELECT round, place, sum(n * moved) / sum(n) AS v FROM msg GROUP BY round, place)
      SELECT CAST(round AS INT) AS version, CAST(place // 8 AS INT) AS layer, CAST(place % 8 AS INT) AS pos, {r("w + sum(v) OVER (PARTITION BY place ORDER BY round)")} AS value FROM a JOIN init USING (place) WHERE node = 0""",
    "q65_stream_frame_timeout": f"""WITH {FRAMES}, g AS (SELECT frame, min(ts) AS first, min(ts) FILTER (WHERE stream = 'color') AS c, min(ts) FILTER (WHERE stream = 'depth') AS d, min(ts) FILTER (WHERE stream = 'ir') AS i FROM fe WHERE stream IS NOT NULL GROUP BY frame),
      t AS (SELECT frame, CASE WHEN c <= first + INTERVAL 10 MINUTE THEN c END AS color_ts, CASE WHEN d <= first + INTERVAL 10 MINUTE THEN d END AS depth_ts, CASE WHEN i <= first + INTERVAL 10 MINUTE THEN i END AS ir_ts FROM g)
      SELECT frame, CASE WHEN color_ts IS NULL OR depth_ts IS NULL OR ir_ts IS NULL THEN 'dropped' ELSE 'complete' END AS status, color_ts, depth_ts, ir_ts FROM t""",
    "q66_stream_power_by_round": f"""WITH {PARSED} SELECT CAST(dayofyear(ts) AS INT) AS round, {POWER}, 86400.0::DOUBLE AS wall_s FROM tot GROUP BY dayofyear(ts)""",
    "q67_local_epochs": local_epochs(),
    "q68_log_numbers": f"""WITH {LOG}, b AS (SELECT strftime(ts, '%Y-%m-%d') AS log, event_id, 0 AS k, value FROM lines UNION ALL SELECT strftime(ts, '%Y-%m-%d'), event_id, 1, '' FROM lines WHERE event_id % 7 = 0)
      SELECT log, row_number() OVER (PARTITION BY log ORDER BY event_id, k) - 1 AS line_num, md5(value) AS line_md5 FROM b""",
    "q69_core_rows": f"""WITH {LOG}, c AS (SELECT event_id, string_split(regexp_extract(value, 'CPU\\s+\\[([^\\]]+)\\]', 1), ',') AS cores FROM lines),
      u AS (SELECT event_id, CAST(unnest(generate_series(0, len(cores) - 1)) AS INT) AS core, trim(unnest(cores)) AS x FROM c)
      SELECT event_id, core, coalesce({field_of('x', '^(\\d+)%@(\\d+)', 1)}, 0) AS load_percent, coalesce({field_of('x', '^(\\d+)%@(\\d+)', 2)}, 0) AS freq_mhz FROM u""",
    "q70_as_of_within": """WITH v AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup', 'error'))
      SELECT p.event_id, p.user_id, CASE WHEN p.ts - v.ts <= INTERVAL 6 HOUR THEN v.seen END AS seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "q71_weight_versions": f"""WITH {PAR}, {AVG} SELECT 1 AS version, layer, pos, {r('value')} AS value FROM avgw UNION ALL SELECT 2, layer, pos, {r('CASE WHEN layer % 2 = 1 THEN arg_min(value, node) ELSE sum(n * value) / sum(n) END')} FROM par GROUP BY layer, pos""",
    "q73_model_factory": f"""WITH {PAR}, k AS (SELECT i, (CAST('0x' || md5('42:' || i)[1:8] AS BIGINT) / 2147483648.0::DOUBLE - 1) / sqrt(8.0::DOUBLE) AS v FROM range(16) t(i)),
      g AS (SELECT layer, count(*) AS n, sum(value) AS t, count(DISTINCT node) AS c FROM par GROUP BY layer)
      SELECT layer, CAST(CASE layer WHEN 0 THEN c * 12 WHEN 7 THEN c * 16 ELSE n END AS BIGINT) AS n_params, {r('CASE layer WHEN 0 THEN t * 1.5 WHEN 7 THEN c * (SELECT sum(v) FROM k) ELSE t END')} AS total FROM g""",
    "q72_bootstrap": f"""WITH o AS (SELECT o_orderpriority AS run, o_orderkey AS k, o_totalprice / 1000 AS v, unnest(generate_series(0, 20)) AS b FROM orders),
      u AS (SELECT *, CAST('0x' || md5(b || ':' || k)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM o),
      w AS (SELECT run, b, v, CASE WHEN b = 0 THEN 1 ELSE {poisson('u')} END AS w FROM u), m AS (SELECT run, b, sum(w) AS w, sum(w * v) / sum(w) AS m FROM w GROUP BY run, b)
      SELECT run, CAST(max(w) FILTER (WHERE b = 0) AS BIGINT) AS n, {r('max(m) FILTER (WHERE b = 0)')} AS mean, {r('quantile_cont(m, 0.05) FILTER (WHERE b > 0)')} AS low, {r('quantile_cont(m, 0.95) FILTER (WHERE b > 0)')} AS high FROM m GROUP BY run""",
}
