"""The same results in SQL over the test tables."""

from __future__ import annotations

from checks.stand_in import HAND_SET
from seqcast.operators.shards import EPOCH_FACTOR, PRIME, ROUND_FACTOR, ROUNDS, VALUE_FACTOR

FEATURES = ("Open", "High", "Low", "Close", "Volume")
WINDOW = 60
BATCH = 64
WORLD = 4
DAILY_KEPT = "'1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'"
HOURLY_KEPT = "'click', 'error', 'purchase', 'view'"

DAILY_BARS = """bars AS (
  SELECT o_orderpriority AS "Symbol", o_orderdate AS "Date",
         arg_min(o_totalprice, o_orderkey) AS "Open", max(o_totalprice) AS "High", min(o_totalprice) AS "Low",
         arg_max(o_totalprice, o_orderkey) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume"
  FROM orders GROUP BY 1, 2)"""
HOURLY_BARS = """bars AS (
  SELECT event_type AS "Symbol", date_trunc('hour', ts) AS "Date",
         arg_min(value, event_id) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, event_id) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume"
  FROM events GROUP BY 1, 2)"""


def _columns(pattern: str, names=FEATURES, joint: str = ", ") -> str:
    return joint.join(pattern.format(c=c, i=i) for i, c in enumerate(names, 1))


def _panel(bars: str = DAILY_BARS, kept: str = DAILY_KEPT) -> str:
    """Tables up to scaled and numbered rows of each series."""
    scaled = _columns('("{c}" - "{c}_min") / CASE WHEN "{c}_max" - "{c}_min" < 2.220446049250313e-15 '
                      'THEN 1 ELSE "{c}_max" - "{c}_min" END AS "{c}_scaled"', joint=",\n         ")
    return f"""WITH {bars},
clean AS (SELECT * FROM bars WHERE "Symbol" IN ({kept})),
calendar AS (SELECT "Date", row_number() OVER (ORDER BY "Date") - 1 AS position, n AS "rows"
             FROM (SELECT "Date", count(*) AS n FROM clean GROUP BY 1)),
places AS (SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS t,
                  CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS v FROM calendar),
cuts AS (SELECT n AS n_dates, t AS train_pos, t + v AS val_pos,
                (SELECT "Date" FROM calendar WHERE position = t) AS train_end,
                (SELECT "Date" FROM calendar WHERE position = t + v) AS val_end FROM places),
divided AS (SELECT CASE WHEN "Date" <= train_end THEN 'train' WHEN "Date" <= val_end THEN 'val' ELSE 'test' END AS split,
                   clean.* FROM clean, cuts),
bounds AS (SELECT {_columns('min("{c}") AS "{c}_min", max("{c}") AS "{c}_max"')} FROM divided WHERE split = 'train'),
numbered AS (
  SELECT split, "Symbol", "Date", "Close", "Close_min", "Close_max",
         {scaled},
         row_number() OVER (PARTITION BY split, "Symbol" ORDER BY "Date") - 1 AS position
  FROM divided, bounds),
samples AS (SELECT * FROM numbered WHERE position >= {WINDOW}),
persisted AS (
  SELECT *, lag("Close") OVER s AS y_pred, "Close_scaled" - lag("Close_scaled") OVER s AS error
  FROM numbered WINDOW s AS (PARTITION BY split, "Symbol" ORDER BY "Date"))"""


PANEL = _panel()
HOURLY_PANEL = _panel(HOURLY_BARS, HOURLY_KEPT)

STEPS = f"""
SELECT y.split, y."Symbol", y."Date", round(y."Close_scaled", 9) AS y,
       x.position - y.position + {WINDOW + 1} AS step, {_columns('round(x."{c}_scaled", 9) AS "{c}"')}
FROM samples y JOIN numbered x
  ON x.split = y.split AND x."Symbol" = y."Symbol"
 AND x.position BETWEEN y.position - {WINDOW} AND y.position - 1"""

METRICS = """count(*) AS n, round(avg((y - p) * (y - p)), 1) AS "MSE", round(sqrt(avg((y - p) * (y - p))), 4) AS "RMSE",
       round(avg(abs(y - p)), 4) AS "MAE",
       round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0), 4) AS "MAPE"
FROM (SELECT split, "Symbol", "Close" AS y, y_pred AS p FROM persisted WHERE position >= 60)"""


def _places() -> str:
    """All rounds of the permutation, from a sample's number ``p`` to ``y * across + x``."""
    rows = "(SELECT *, p % across AS x, p // across AS y FROM walk, grid)"
    for r in range(ROUNDS):
        own, other, size = ("y", "x", "down") if r % 2 else ("x", "y", "across")
        key = f"(epoch * {EPOCH_FACTOR} + {r * ROUND_FACTOR % PRIME}) % {PRIME}"
        rows = (f"(SELECT * EXCLUDE (t) REPLACE (({own} + t * t % {PRIME} * t % {PRIME}) % {size} AS {own})\n"
                f" FROM (SELECT *, ({other} * {VALUE_FACTOR} + {key}) % {PRIME} AS t FROM {rows}))")
    return rows


def _dealt(world: int, epochs: str) -> str:
    """Train samples dealt to ranks and batches, the permutation continued until it divides."""
    return f"""{PANEL.replace("WITH ", "WITH RECURSIVE ", 1)},
counted AS (SELECT "Symbol", "Date", row_number() OVER (ORDER BY "Symbol", "Date") - 1 AS number, count(*) OVER () AS size
            FROM samples WHERE split = 'train'),
grid AS (SELECT DISTINCT CAST(ceil(sqrt(size)) AS BIGINT) AS across, CAST(ceil(size / ceil(sqrt(size))) AS BIGINT) AS down FROM counted),
walk AS (
  SELECT CAST(epoch AS BIGINT) AS epoch, "Symbol", "Date", size, number AS p, 0 AS taken FROM counted, (SELECT unnest([{epochs}]) AS epoch)
  UNION ALL
  SELECT epoch, "Symbol", "Date", size, y * across + x, taken + 1 FROM {_places()} WHERE taken = 0 OR p >= size),
drawn AS (SELECT CAST(epoch AS INTEGER) AS epoch, "Symbol", "Date", p AS place, size FROM walk WHERE taken > 0 AND p < size),
placed AS (SELECT epoch, "Symbol", "Date",
                  unnest(generate_series(place, CAST(ceil(size / {world}::DOUBLE) AS BIGINT) * {world} - 1, size)) AS pos
           FROM drawn),
dealt AS (SELECT epoch, CAST(pos % {world} AS INTEGER) AS rank, pos,
                 (pos // {world}) // {BATCH} AS batch, "Symbol", "Date" FROM placed)"""


LOSSES = f"""{_dealt(WORLD, '0, 1')},
losses AS (SELECT epoch, rank, batch, avg(error * error) AS loss, count(*) AS size
           FROM dealt JOIN persisted USING ("Symbol", "Date") GROUP BY 1, 2, 3),
by_rank AS (SELECT epoch, rank, avg(loss) AS loss, count(*) AS n_batches FROM losses GROUP BY 1, 2)"""

RUNS = """WITH runs AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linestatus = 'F' THEN 'distributed' ELSE 'standalone' END AS run_type,
         l_linenumber AS num_processes, l_returnflag AS storage, l_returnflag || ',' || l_linestatus AS symbols,
         l_partkey AS n_samples, l_extendedprice / 7 AS seconds, l_shipdate AS finished,
         round(l_quantity * l_quantity / 7, 4) AS "MSE", round(l_quantity / 7, 4) AS "RMSE",
         round(l_tax / 7, 4) AS "MAE", round(l_discount * 100 / 7, 4) AS "MAPE"
  FROM lineitem),
named AS (SELECT *, CASE WHEN run_type = 'distributed' THEN 'Distributed_MultiStock_' || num_processes || 'proc'
                    ELSE 'Standalone_MultiStock_2tickers' END || '_' || strftime(finished, '%Y%m%d_%H%M') AS run_name,
                 CASE WHEN run_type = 'distributed' THEN num_processes END AS stated, round(seconds, 2) AS logged,
                 CASE WHEN run_type = 'distributed' THEN num_processes ELSE 1 END AS sized,
                 l_orderkey || '.' || l_linenumber AS uniq FROM runs)"""

def _gate(row: int) -> str:
    """Input of a gate of the hand-set unit: its bar as 32-bit floats, the state before, and both biases."""
    ih, hh, b, c = (HAND_SET[f"lstm.{n}_l0"][row] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh"))
    inputs = " + ".join(f'{w} * CAST(CAST(x."{n}_scaled" AS FLOAT) AS DOUBLE)' for n, w in zip(FEATURES, ih))
    return f"{inputs} + {hh[0]} * s.h + {b} + {c}"


# The unit's recurrence, a step at a time over all windows of the test period.
GRAM = ", ".join(f'round(sum({a} * {b}), 4) AS "{n}_{m}"' for n, a in (("one", "CAST(1 AS DOUBLE)"), *((c, f'x."{c}_scaled"') for c in FEATURES))
                 for m, b in (("one", "CAST(1 AS DOUBLE)"), *((c, f'z."{c}_scaled"') for c in FEATURES)))

SCORED = f"""{PANEL.replace("WITH ", "WITH RECURSIVE ", 1)},
states AS (
  SELECT split, "Symbol", "Date", position, 0 AS step, CAST(0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS c FROM samples WHERE split = 'test'
  UNION ALL
  SELECT split, "Symbol", "Date", position, step + 1, 1 / (1 + exp(-o)) * tanh(new_c), new_c
  FROM (SELECT *, 1 / (1 + exp(-f)) * c + 1 / (1 + exp(-i)) * tanh(g) AS new_c
        FROM (SELECT s.*, {_gate(0)} AS i, {_gate(1)} AS f, {_gate(2)} AS g, {_gate(3)} AS o
              FROM states s JOIN numbered x
                ON x.split = s.split AND x."Symbol" = s."Symbol" AND x.position = s.position - {WINDOW} + s.step
              WHERE s.step < {WINDOW}))),
scored AS (
  SELECT split, "Symbol", "Date", CAST(CAST("Close_scaled" AS FLOAT) AS DOUBLE) AS y,
         CAST(CAST({HAND_SET["fc.weight"][0][0]} * h + {HAND_SET["fc.bias"][0]} AS FLOAT) AS DOUBLE) AS p
  FROM states JOIN numbered USING (split, "Symbol", "Date", position) WHERE step = {WINDOW})"""

# Both sides of the two tests at once; each row walks its continued fraction.
EQUIVALENCE = f"""{RUNS.replace("WITH ", "WITH RECURSIVE ", 1)},
stats AS (SELECT sized AS num_processes, count(*) AS runs, avg("MAPE") AS mean, var_samp("MAPE") / count(*) AS v FROM named GROUP BY 1),
base AS (SELECT runs AS n, mean AS m, v AS w FROM stats WHERE num_processes = 1),
compared AS (SELECT num_processes, runs, mean, mean - m AS difference, abs(m) / 20 AS bound, sqrt(v + w) AS error,
                    (v + w) * (v + w) / (v * v / (runs - 1) + w * w / (n - 1)) AS freedom FROM stats, base WHERE num_processes <> 1),
sides AS (SELECT num_processes, freedom, unnest([(difference + bound) / error, (bound - difference) / error]) AS t FROM compared),
betas AS (SELECT *, freedom / (freedom + t * t) AS x0, freedom / 2 AS a0, CAST(0.5 AS DOUBLE) AS b0 FROM sides),
turned AS (SELECT *, x0 > (a0 + 1) / (a0 + b0 + 2) AS turn FROM betas),
ready AS (SELECT num_processes, t, turn, CASE WHEN turn THEN b0 ELSE a0 END AS a, CASE WHEN turn THEN a0 ELSE b0 END AS b,
                 CASE WHEN turn THEN 1 - x0 ELSE x0 END AS x FROM turned),
lentz AS (
  SELECT *, 0 AS k, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM ready
  UNION ALL
  SELECT num_processes, t, turn, a, b, x, k + 1, 1 + e / c, 1 / (1 + e * d), h * (1 + e / c) / (1 + e * d)
  FROM (SELECT *, CASE WHEN k % 2 = 1 THEN -(a + k // 2 + 1) * (a + b + k // 2 + 1) * x / ((a + k + 1) * (a + k + 2))
                       ELSE (k // 2 + 1) * (b - k // 2 - 1) * x / ((a + k + 1) * (a + k + 2)) END AS e FROM lentz WHERE k < 800)),
tails AS (SELECT num_processes, t, turn, CASE WHEN x <= 0 THEN 0 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a END AS i
          FROM lentz WHERE k = 800),
chances AS (SELECT num_processes, max(CASE WHEN t >= 0 THEN tail ELSE 1 - tail END) AS p
            FROM (SELECT num_processes, t, CASE WHEN turn THEN 1 - i ELSE i END / 2 AS tail FROM tails) GROUP BY 1)
SELECT num_processes, runs, round(mean, 6) AS mean, round(difference, 6) AS difference, round(freedom, 6) AS freedom, round(p, 6) AS p, p < 0.05 AS equivalent
FROM compared JOIN chances USING (num_processes)"""

ORACLES: dict[str, str] = {
    "scan_bars": f'WITH {DAILY_BARS} SELECT "Symbol", "Date", {_columns(chr(34) + "{c}" + chr(34))} FROM bars',
    "filter_symbols": f'WITH {DAILY_BARS} SELECT * FROM bars WHERE "Symbol" IN ({DAILY_KEPT})',
    "parse_dates": f"""WITH {DAILY_BARS}, texts AS (
  SELECT "Symbol", strftime("Date", '%Y-%m-%d %H:%M:%S') || CASE WHEN "Volume" = 1 THEN '?' ELSE '' END AS date_text FROM bars)
SELECT "Symbol", date_text, TRY_CAST(date_text AS TIMESTAMP) AS "Date" FROM texts""",
    "project_features": f'WITH {DAILY_BARS} SELECT "Symbol", "Date", "Volume", "Close" FROM bars',
    "drop_missing": f'WITH {DAILY_BARS} SELECT * FROM bars WHERE "Volume" > 2',
    "sorted_bars": f"""WITH {DAILY_BARS}
SELECT *, row_number() OVER (ORDER BY "Symbol", "Date") - 1 AS position FROM bars WHERE "Symbol" IN ({DAILY_KEPT})""",
    "date_calendar": f"{PANEL} SELECT * FROM calendar",
    "split_cutoffs": f"{PANEL} SELECT * FROM cuts",
    "chrono_split": f'{PANEL} SELECT "Symbol", "Date", split FROM divided',
    "scaler_fit": f"{PANEL} SELECT * FROM bounds",
    "scaler_fit_in_batches": f"{PANEL} SELECT * FROM bounds",
    "scaled_bars": f"""{PANEL}
SELECT split, "Symbol", "Date", {_columns('round("{c}_scaled", 9) AS "{c}_scaled"')} FROM numbered""",
    "unscale_target": f'{PANEL} SELECT "Symbol", "Date", round("Close", 4) AS "Close_back" FROM divided',
    "float32_roundtrip": f"""{PANEL}
SELECT "Symbol", "Date", round(CAST(CAST("Close_scaled" AS FLOAT) AS DOUBLE), 9) AS "Close_float" FROM numbered""",
    "sequences": f"{PANEL} {STEPS}",
    "sequences_in_cells": f"{HOURLY_PANEL} {STEPS}",
    "sequences_from_store": f"{PANEL} {STEPS}",
    "series_positions": f'{HOURLY_PANEL} SELECT split, "Symbol", "Date", position FROM numbered',
    "sequence_counts": f"""{PANEL}
SELECT split, "Symbol", count(*) AS n_rows, greatest(count(*) - {WINDOW}, 0) AS n_sequences FROM divided GROUP BY 1, 2""",
    "flat_features": f"""{PANEL}
SELECT y.split, y."Symbol", y."Date", CAST({len(FEATURES)} * count(*) AS BIGINT) AS n_values,
       round(sum({_columns(f'x."{{c}}_scaled" * ({len(FEATURES)} * (x.position - y.position + {WINDOW}) + {{i}})', joint=" + ")}), 4)
         AS weighted_sum
FROM samples y JOIN numbered x
  ON x.split = y.split AND x."Symbol" = y."Symbol"
 AND x.position BETWEEN y.position - {WINDOW} AND y.position - 1
GROUP BY 1, 2, 3""",
    "last_step": f"""{PANEL}
SELECT y.split, y."Symbol", y."Date", {_columns('round(x."{c}_scaled", 9) AS "{c}"')}
FROM samples y JOIN numbered x
  ON x.split = y.split AND x."Symbol" = y."Symbol" AND x.position = y.position - 1""",
    "regression_metrics": f"{PANEL} SELECT {METRICS} WHERE split = 'test'",
    "metrics_by_symbol": f'{PANEL} SELECT split, "Symbol", {METRICS} GROUP BY 1, 2',
    "mape_masked": """SELECT l_returnflag, l_linenumber,
       round(coalesce(avg(CASE WHEN l_discount <> 0 THEN abs((l_discount - l_tax) / l_discount) END) * 100, 0), 6) AS "MAPE",
       count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "batch_losses": f"{LOSSES} SELECT epoch, rank, batch, round(loss, 9) AS loss, size FROM losses",
    "epoch_loss_weighted": f"{LOSSES} SELECT epoch, round(sum(loss * size) / sum(size), 9) AS loss FROM losses GROUP BY 1",
    "epoch_loss_by_rank": f"{LOSSES} SELECT epoch, rank, round(loss, 9) AS loss, n_batches FROM by_rank",
    "epoch_loss_allreduce": f"{LOSSES} SELECT epoch, round(avg(loss), 9) AS loss, count(*) AS world_size FROM by_rank GROUP BY 1",
    "shard_assignment": f"{_dealt(WORLD, '0')} SELECT * FROM dealt",
    "epoch_reshuffle": f"{_dealt(WORLD, '1, 2')} SELECT * FROM dealt",
    "train_batches": f"{_dealt(1, '0')} SELECT * EXCLUDE (rank) FROM dealt",
    "ordered_batches": f"""{PANEL}, placed AS (
  SELECT split, "Symbol", "Date", row_number() OVER (PARTITION BY split ORDER BY "Symbol", "Date") - 1 AS pos FROM samples)
SELECT *, pos // {BATCH} AS batch FROM placed""",
    "run_summary": f"""{RUNS}
SELECT run_name || '-' || uniq AS run_id, run_name, run_type, stated AS num_processes, storage, symbols AS stocks_analyzed,
       n_samples AS total_training_samples, logged AS training_time_seconds, stated AS stopped_at_epoch, "MSE", "RMSE", "MAE", "MAPE"
FROM named""",
    "run_name": f"""{RUNS}
SELECT l_orderkey, l_linenumber, run_name, run_name || '-' || uniq AS run_id, 'modello_' || run_name || '-' || uniq AS weights_name FROM named""",
    "curve_milestones": """WITH curves AS (
  SELECT CAST(o_custkey AS VARCHAR) AS run_id,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
         sqrt(avg(o_totalprice)) / 7000 AS train_loss, sqrt(avg(o_totalprice)) / 13000 AS val_loss
  FROM orders GROUP BY 1, 2)
SELECT run_id, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
       printf('Epoch [%03d/%d] - Train Loss: %.6f - Val Loss: %.6f', epoch, 200, train_loss, val_loss) AS line
FROM curves WHERE epoch = 1 OR epoch % 10 = 0""",
    "speedup_report": f"""{RUNS}, means AS (SELECT sized AS num_processes, avg(logged) AS seconds FROM named GROUP BY 1),
base AS (SELECT seconds AS one FROM means WHERE num_processes = 1)
SELECT num_processes, round(seconds, 6) AS seconds, round(one / seconds, 6) AS speedup,
       round(one / seconds / num_processes, 6) AS efficiency FROM means, base""",
    "storage_report": f"""{RUNS}, means AS (SELECT storage, avg(logged) AS seconds FROM named GROUP BY 1),
base AS (SELECT seconds AS local FROM means WHERE storage = 'N')
SELECT storage, round(seconds, 6) AS seconds, round((local - seconds) / local * 100, 6) AS improvement FROM means, base""",
    "accuracy_report": f"""{RUNS}
SELECT sized AS num_processes, count(*) AS runs, round(avg("MAPE"), 6) AS "MAPE", round(avg("RMSE"), 6) AS "RMSE" FROM named GROUP BY 1""",
    "repeat_stats": f"""{RUNS}
SELECT run_type, stated AS num_processes, storage, count(*) AS runs, round(avg(logged), 6) AS mean, round(min(logged), 6) AS low,
       round(max(logged), 6) AS high, round(stddev_samp(logged), 6) AS spread FROM named GROUP BY 1, 2, 3""",
    "equivalence_report": EQUIVALENCE,
    "parse_dates_by_format": f"""WITH {DAILY_BARS}, texts AS (
  SELECT "Symbol", CASE WHEN "Volume" = 1 THEN '?' ELSE '' END || strftime("Date", '%m/%d/%Y') AS date_text FROM bars)
SELECT "Symbol", date_text, CAST(try_strptime(date_text, '%m/%d/%Y') AS TIMESTAMP) AS "Date" FROM texts""",
    "learning_curve": """SELECT o_orderpriority AS run_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
       round(sqrt(avg(o_totalprice)) / 7000, 9) AS train_loss, round(sqrt(avg(o_totalprice)) / 13000, 9) AS val_loss
FROM orders GROUP BY 1, 2""",
    "model_table": """SELECT l_returnflag || l_linestatus AS run_id, count(*) AS n_arrays, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS n_shaped,
       round(sum(l_tax * CAST(l_quantity AS INTEGER)), 4) AS total, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS n_parameters
FROM lineitem GROUP BY 1""",
    "score_sequences": f"""{SCORED}
SELECT split, "Symbol", "Date", round(y, 6) AS y, round(p, 6) AS p FROM scored""",
    "forecast_actual": f"""{SCORED}
SELECT split, "Symbol", "Date", round(y * ("Close_max" - "Close_min") + "Close_min", 3) AS y_actual,
       round(p * ("Close_max" - "Close_min") + "Close_min", 3) AS y_pred FROM scored, bounds""",
    "window_gram": f"""{PANEL}, train AS (SELECT * FROM numbered WHERE split = 'train'),
runs AS (SELECT "Symbol", position - {WINDOW} AS start FROM train WHERE position >= {WINDOW})
SELECT CAST(x.position - start AS INTEGER) AS i, CAST(z.position - start AS INTEGER) AS j, {GRAM}
FROM runs JOIN train x ON x."Symbol" = runs."Symbol" AND x.position BETWEEN start AND start + {WINDOW}
          JOIN train z ON z."Symbol" = runs."Symbol" AND z.position BETWEEN x.position AND start + {WINDOW}
GROUP BY 1, 2""",
    "fit_window_regressor": f"""{PANEL},
pairs AS (SELECT *, lag("Close_scaled") OVER (PARTITION BY split, "Symbol" ORDER BY "Date") AS x FROM numbered),
line AS (SELECT regr_slope("Close_scaled", x) AS slope, regr_intercept("Close_scaled", x) AS intercept FROM pairs WHERE split = 'train'),
forecasts AS (SELECT "Symbol", "Close" AS y, (x * slope + intercept) * ("Close_max" - "Close_min") + "Close_min" AS p
              FROM pairs, line WHERE split = 'test' AND x IS NOT NULL)
SELECT "Symbol", count(*) AS n, round(avg((y - p) * (y - p)) / 1e6, 1) AS "MSE", round(sqrt(avg((y - p) * (y - p))), 1) AS "RMSE",
       round(avg(abs(y - p)), 1) AS "MAE", round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0), 4) AS "MAPE"
FROM forecasts GROUP BY 1""",
}
