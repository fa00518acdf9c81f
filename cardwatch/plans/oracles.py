"""The registered queries once more as plain SQL for an independent engine (DuckDB).

Written out directly, with row numbers, sorts and whole-table windows where the jobs avoid them.
"""

from __future__ import annotations

from cardwatch.functions.features import FEATURE_COLUMNS
from cardwatch.operators.monitoring import PROBABILITY_BOUNDS
from cardwatch.operators.profiling import PROFILE_FEATURES
from cardwatch.plans.registry import AS_OF, SWEEP_THRESHOLDS
from cardwatch.sources.config import load_rules
from cardwatch.sources.events_view import DIRTY_SQL, TRANSACTION_SQL


def _d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())


TXN = f"txn AS (SELECT {_select(TRANSACTION_SQL)} FROM events)"
DIRTY = (
    f"dirty AS (SELECT event_id, {_select(DIRTY_SQL)} "
    "FROM (SELECT *, CAST(substr(transaction_id, 2) AS BIGINT) AS event_id FROM txn))"
)
FEATURES = f"""
feat AS (SELECT transaction_id, timestamp, customer_id, card_id, merchant_id, amount, channel, merchant_mcc,
  merchant_country, card_country, is_fraud, customer_age_days, card_age_days, n_tx_last_1h, n_tx_last_24h,
  amount_avg_30d, amount_std_30d, distinct_countries_last_24h,
  ln({_d(1.0)} + amount) AS amount_log,
  greatest({_d(0.0)}, least({_d(100.0)}, coalesce(amount / nullif(amount_avg_30d, 0), {_d(1.0)}))) AS amount_ratio_avg_30d,
  greatest({_d(-20.0)}, least({_d(20.0)}, coalesce((amount - amount_avg_30d) / nullif(amount_std_30d, 0), {_d(0.0)})))
    AS amount_zscore_30d,
  (n_tx_last_1h * {_d(3.0)} + n_tx_last_24h) / {_d(10.0)} AS velocity_score,
  CAST(n_tx_last_1h >= 5 AS INT) AS is_burst_1h,
  CAST(hour(timestamp) AS INT) AS hour,
  CAST(hour(timestamp) <= 5 AS INT) AS is_night,
  CAST(isodow(timestamp) IN (6, 7) AS INT) AS is_weekend,
  CAST(upper(merchant_country) <> upper(card_country) AS INT) AS is_geo_mismatch,
  CAST(is_cnp AS INT) AS is_cnp,
  CAST(channel = 'ECOM' AS INT) AS is_ecom,
  CAST(channel = 'ATM' AS INT) AS is_atm,
  CAST(merchant_mcc IN ('7995', '5967') AS INT) AS is_high_risk_mcc
  FROM txn)"""

RULE_SQL = {
    "R001_HIGH_AMOUNT_CNP": "is_cnp = 1 AND amount >= 1000",
    "R002_VERY_HIGH_AMOUNT": "amount >= 5000",
    "R003_GEO_MISMATCH_ECOM": "channel = 'ECOM' AND is_geo_mismatch = 1",
    "R004_VELOCITY_BURST": "n_tx_last_1h >= 8",
    "R005_HIGH_RISK_MCC": "merchant_mcc IN ('7995', '5967')",
    "R006_NIGHT_ATM": "channel = 'ATM' AND hour <= 5",
    "R007_NEW_CARD_LARGE_AMOUNT": "card_age_days < 7 AND amount >= 300",
    "R008_MULTI_COUNTRY_24H": "distinct_countries_last_24h >= 3",
    "R009_ZSCORE_OUTLIER": "amount_zscore_30d >= 6",
}
SEVERITY = {rule.code: rule.severity for rule in load_rules()}
HARD = [code for code in RULE_SQL if SEVERITY[code] == "HARD_BLOCK"]
SUSPECT = [code for code in RULE_SQL if SEVERITY[code] == "SUSPECT"]


def _any(codes: list[str]) -> str:
    return "(" + " OR ".join(f"({RULE_SQL[code]})" for code in codes) + ")"


def _count(codes: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {RULE_SQL[code]} THEN 1 ELSE 0 END" for code in codes) + ")"


def _listed(codes: list[str], prefix: str = "") -> str:
    parts = ", ".join(f"CASE WHEN {RULE_SQL[code]} THEN '{prefix}{code}' END" for code in codes)
    return f"concat_ws('|', {parts})"


def _probability(intercept: float) -> str:
    total = (
        f"({_d(intercept)} + {_d(0.15)} * amount_zscore_30d + {_d(0.8)} * is_geo_mismatch + {_d(0.5)} * is_cnp"
        f" + {_d(0.9)} * is_high_risk_mcc + {_d(0.6)} * is_night + {_d(0.5)} * velocity_score)"
    )
    return f"round({_d(1.0)} / ({_d(1.0)} + exp(-{total})), 6)"


def _scored(name: str = "scored", intercept: float = -4.0) -> str:
    """Model probability ``p``, published probability, decision; one row per transaction."""
    return f"""
{name}_p AS (SELECT *, {_probability(intercept)} AS p, {_any(HARD)} AS hard, {_count(SUSPECT)} AS n_suspect FROM feat),
{name}_d AS (SELECT *, CASE WHEN hard THEN {_d(1.0)} ELSE p END AS fraud_probability,
  CASE WHEN hard THEN {_d(1.0)} ELSE least({_d(1.0)}, p + least({_d(0.2)}, {_d(0.05)} * n_suspect)) END AS adjusted_probability
  FROM {name}_p),
{name} AS (SELECT *,
  CASE WHEN adjusted_probability >= {_d(0.7)} THEN 'DECLINE' WHEN adjusted_probability >= {_d(0.3)} THEN 'REVIEW'
    ELSE 'APPROVE' END AS action,
  CAST(round_even(adjusted_probability * {_d(1000.0)}, 0) AS INT) AS risk_score,
  CASE WHEN hard THEN {_listed(HARD, 'rule:')}
    ELSE concat_ws('|', nullif({_listed(SUSPECT, 'rule:')}, ''), concat('ml:p=', printf('%.3f', adjusted_probability),
      CASE WHEN adjusted_probability >= {_d(0.7)} THEN '>=decline_threshold'
        WHEN adjusted_probability >= {_d(0.3)} THEN '>=review_threshold' ELSE '<review_threshold' END)) END AS reasons,
  {_listed(list(RULE_SQL))} AS rule_codes,
  {_count(list(RULE_SQL))} AS n_hits
  FROM {name}_d)"""


HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT transaction_id, timestamp, '{code}' AS code, '{SEVERITY[code]}' AS severity FROM feat WHERE {sql}"
    for code, sql in RULE_SQL.items()
) + ")"
CODES = "codes AS (" + " UNION ALL ".join(
    f"SELECT '{code}' AS code, '{severity}' AS severity" for code, severity in SEVERITY.items()
) + ")"


def _split(test: float = 0.2, validation: float | None = None, source: str = "feat") -> str:
    n_train = f"CAST(floor(total * ({_d(1.0)} - {_d(test)})) AS BIGINT)"
    names = f"CASE WHEN place <= {n_train} THEN 'train' ELSE 'test' END"
    if validation is not None:
        n_fit = f"CAST(floor({n_train} * ({_d(1.0)} - {_d(validation)})) AS BIGINT)"
        names = f"CASE WHEN place <= {n_fit} THEN 'fit' WHEN place <= {n_train} THEN 'val' ELSE 'test' END"
    return (
        f"placed AS (SELECT *, row_number() OVER (ORDER BY timestamp, transaction_id) AS place, count(*) OVER () AS total "
        f"FROM {source}), parted AS (SELECT *, {names} AS split FROM placed)"
    )


def _long(source: str, columns: list[str], keep: str, name: str = "long") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keep}, '{column}' AS feature, CAST({column} AS DOUBLE) AS value FROM {source}" for column in columns
    )
    return f"{name} AS ({parts})"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


BASE = _with(TXN, FEATURES)
SCORED = _with(TXN, FEATURES, _scored())

# Field errors of the dirty rows, in the order of the contract.
ERROR_SQL = [
    ("transaction_id", "missing", "transaction_id IS NULL"),
    ("amount", "range", "NOT (amount > 0 AND amount < 1000000)"),
    ("currency", "not_allowed", "currency = 'XXX'"),
    ("merchant_country", "length", "length(merchant_country) <> 2"),
    ("merchant_mcc", "length", "length(merchant_mcc) <> 4"),
    ("channel", "not_allowed", "channel NOT IN ('POS', 'ECOM', 'ATM', 'MOTO')"),
    ("n_tx_last_1h", "range", "n_tx_last_1h < 0"),
    ("amount_std_30d", "range", "isnan(amount_std_30d)"),
]
NOTE_ERROR = ("note", "unknown_field", "event_id % 107 = 0")


def _error_text(errors) -> str:
    parts = ", ".join(f"CASE WHEN {sql} THEN '{field}:{code}' END" for field, code, sql in errors)
    return f"concat_ws(',', {parts})"


def _bad(errors) -> str:
    return "(" + " OR ".join(f"coalesce({sql}, false)" for _, _, sql in errors) + ")"


def _valid(errors) -> str:
    return _with(TXN, DIRTY) + f"""
SELECT transaction_id, epoch_us(timestamp) AS timestamp, trim(customer_id) AS customer_id, card_id, amount,
  coalesce(currency, 'EUR') AS currency, merchant_id, upper(merchant_country) AS merchant_country, merchant_mcc,
  card_country, channel, is_cnp, customer_age_days, card_age_days, n_tx_last_1h, n_tx_last_24h, amount_avg_30d,
  amount_std_30d, distinct_countries_last_24h
FROM dirty WHERE NOT {_bad(errors)}"""


def _frame(interval: str) -> str:
    return f"(PARTITION BY card_id ORDER BY timestamp RANGE BETWEEN {interval} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


HOUR, DAY, MONTH = _frame("INTERVAL 1 HOUR"), _frame("INTERVAL 24 HOUR"), _frame("INTERVAL 720 HOUR")
VELOCITY = _with(TXN) + f"""
SELECT transaction_id, CAST(count(*) OVER {HOUR} AS INT) AS n_tx_last_1h, CAST(count(*) OVER {DAY} AS INT) AS n_tx_last_24h,
  coalesce(CAST(sum(CAST(amount AS DECIMAL(18, 6))) OVER {MONTH} AS DOUBLE) / count(*) OVER {MONTH}, 0) AS amount_avg_30d,
  round(coalesce(stddev_samp(amount) OVER {MONTH}, 0), 6) AS amount_std_30d,
  CAST(count(DISTINCT merchant_country) OVER {DAY} AS INT) AS distinct_countries_last_24h
FROM txn"""

AUC = _with(TXN, FEATURES, _scored()) + f"""
, grouped AS (SELECT p, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS pos FROM scored GROUP BY p),
running AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER (ORDER BY p DESC) AS cp,
  sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM grouped)
SELECT round(CAST(sum((n - pos) * (cp - pos / {_d(2.0)})) AS DOUBLE) / max(tp) / max(tn - tp), 9) AS roc_auc,
  round(sum(CAST(pos AS DOUBLE) * cp / cn) / max(tp), 9) AS pr_auc,
  round(max(CASE WHEN CAST(cn - cp AS DOUBLE) / (tn - tp) <= {_d(0.01)} THEN CAST(cp AS DOUBLE) / tp ELSE 0 END), 9) AS recall_at_fpr,
  CAST(max(tn) AS BIGINT) AS n_rows, CAST(max(tp) AS BIGINT) AS n_pos
FROM running"""

TOP = """
ordered AS (SELECT is_fraud, row_number() OVER (ORDER BY p DESC, transaction_id) AS place,
  greatest(1, CAST(floor(count(*) OVER () * CAST(0.01 AS DOUBLE)) AS BIGINT)) AS k FROM scored),
top AS (SELECT max(k) AS k, CAST(sum(is_fraud) AS DOUBLE) / max(k) AS precision FROM ordered WHERE place <= k)"""


def _confusion(source: str) -> str:
    return f"""
cells AS (SELECT count(*) FILTER (p < {_d(0.5)} AND is_fraud = 0) AS tn, count(*) FILTER (p >= {_d(0.5)} AND is_fraud = 0) AS fp,
  count(*) FILTER (p < {_d(0.5)} AND is_fraud = 1) AS fn, count(*) FILTER (p >= {_d(0.5)} AND is_fraud = 1) AS tp FROM {source}),
rates AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM cells)"""


REPORT_NAMES = {
    "roc_auc": "roc_auc",
    "pr_auc": "pr_auc",
    "recall_at_1pct_fpr": "recall_at_fpr",
    "n_rows": "n_rows",
    "n_fraud": "n_pos",
}
RATE_NAMES = {
    "precision_default": "precision",
    "recall_default": "recall",
    "f1_at_default_threshold": "f1",
    "tn": "tn",
    "fp": "fp",
    "fn": "fn",
    "tp": "tp",
}


def _psi(old: str, new: str, columns: list[str], extra: str = "") -> str:
    """Index per feature between the rows of ``parted`` that satisfy the two conditions."""
    points = ", ".join(_d(i * 0.1) for i in range(10)) + f", {_d(1.0)}"
    return f"""
{_long('parted', columns, 'split, is_fraud')},
ends AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{points}]))) AS e FROM long WHERE {old} GROUP BY feature),
usable AS (SELECT feature, e[2:len(e) - 1] AS e FROM ends WHERE len(e) > 2),
binned AS (SELECT feature, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) FILTER ({old}) AS n_old,
  count(*) FILTER ({new}) AS n_new FROM long JOIN usable USING (feature) GROUP BY ALL),
bins AS (SELECT feature, unnest(range(0, len(e) + 1)) AS bin FROM usable),
shares AS (SELECT feature,
  CAST(coalesce(n_old, 0) AS DOUBLE) / sum(n_old) OVER (PARTITION BY feature) + {_d(1e-6)} AS a,
  CAST(coalesce(n_new, 0) AS DOUBLE) / sum(n_new) OVER (PARTITION BY feature) + {_d(1e-6)} AS b
  FROM bins LEFT JOIN binned USING (feature, bin)),
summed AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM shares GROUP BY feature),
psi AS (SELECT feature, round(coalesce(psi, 0), 9) AS psi FROM ends LEFT JOIN summed USING (feature)){extra}"""


TRAIN_STATS = f"""
{_long('parted', FEATURE_COLUMNS, 'split')},
stats AS (SELECT feature, avg(value) AS mean, stddev_samp(value) + {_d(1e-9)} AS std,
  quantile_cont(value, {_d(0.01)}) AS p01, quantile_cont(value, {_d(0.99)}) AS p99 FROM long WHERE split = 'train' GROUP BY feature)"""


def _means(group: str, first: str, second: str, names: tuple[str, str]) -> str:
    return (
        _long("parted", PROFILE_FEATURES, "split, is_fraud")
        + f", means AS (SELECT feature, avg(value) FILTER ({group} = {first}) AS {names[0]}, "
        f"avg(value) FILTER ({group} = {second}) AS {names[1]} FROM long GROUP BY feature)"
    )


def _decline(unit: str) -> str:
    return SCORED + f"""
, periods AS (SELECT date_trunc('{unit}', timestamp) AS t, count(*) AS n_rows, count(*) FILTER (action = 'DECLINE') AS n_declined
  FROM scored GROUP BY 1),
rated AS (SELECT *, CAST(n_declined AS DOUBLE) / n_rows AS decline_rate FROM periods),
lagged AS (SELECT *, lag(decline_rate) OVER (ORDER BY t) AS rate_before FROM rated)
SELECT strftime(t, '%Y-%m-%d %H:%M') AS period, n_rows, n_declined, decline_rate, rate_before,
  decline_rate BETWEEN {_d(0.005)} AND {_d(0.03)} AS in_target,
  coalesce(rate_before > 0 AND decline_rate >= 2 * rate_before, false) AS jumped FROM lagged"""


def _correlation() -> str:
    columns = [*PROFILE_FEATURES, "is_fraud"]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN corr({a}, {b}) END, 9) "
        "AS correlation FROM feat"
        for a, b in pairs
    )
    return BASE + parts


def _sweep() -> str:
    values = ", ".join(f"({_d(t)})" for t in SWEEP_THRESHOLDS)
    return SCORED + f"""
, limits(threshold) AS (VALUES {values})
SELECT threshold, count(*) FILTER (p >= threshold) AS flagged,
  count(*) FILTER (p >= threshold AND is_fraud = 1) AS caught,
  coalesce(CAST(count(*) FILTER (p >= threshold AND is_fraud = 1) AS DOUBLE) / nullif(count(*) FILTER (p >= threshold), 0), 0) AS precision,
  CAST(count(*) FILTER (p >= threshold AND is_fraud = 1) AS DOUBLE) / count(*) FILTER (is_fraud = 1) AS recall,
  round({_d(5.0)} * count(*) FILTER (p >= threshold AND is_fraud = 0)
    + coalesce(sum(amount) FILTER (p < threshold AND is_fraud = 1), 0), 4) AS cost
FROM limits, scored GROUP BY threshold"""


def _backtest() -> str:
    new = {code: sql for code, sql in RULE_SQL.items() if code != "R006_NIGHT_ATM"}
    new["R002_VERY_HIGH_AMOUNT"] = "amount >= 500"
    new["R010_NOTE_LARGE"] = "amount >= 2000"
    parts = []
    for code in sorted(RULE_SQL.keys() | new.keys()):
        old_sql, new_sql = RULE_SQL.get(code, "false"), new.get(code, "false")
        parts.append(
            f"SELECT '{code}' AS code, count(*) FILTER ({old_sql}) AS n_old, count(*) FILTER ({new_sql}) AS n_new, "
            f"count(*) FILTER (({new_sql}) AND NOT ({old_sql})) AS n_gained, "
            f"count(*) FILTER (({old_sql}) AND NOT ({new_sql})) AS n_lost FROM feat"
        )
    return BASE + " UNION ALL ".join(parts)


def _stream_windows(hours: int, slide: int) -> str:
    starts = ", ".join(f"date_trunc('hour', timestamp) - INTERVAL {i * slide} HOUR" for i in range(hours // slide))
    return SCORED + f"""
SELECT epoch_us(w) AS window_micros, action, count(*) AS n_rows
FROM (SELECT unnest([{starts}]) AS w, action FROM scored) GROUP BY ALL"""


BURSTS = _with(TXN) + """
, gaps AS (SELECT card_id, amount, epoch_us(timestamp) AS k,
  epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY card_id ORDER BY timestamp) AS pause FROM txn),
runs AS (SELECT *, sum(CASE WHEN pause < 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY card_id ORDER BY k) AS run FROM gaps),
found AS (SELECT card_id, min(k) AS started_micros, max(k) AS ended_micros, count(*) AS n_tx,
  CAST(sum(CAST(amount AS DECIMAL(18, 6))) AS DOUBLE) AS total_amount FROM runs GROUP BY card_id, run)
"""

ATTACK = """
tagged AS (SELECT *, CASE
  WHEN channel = 'ECOM' AND amount BETWEEN 0.5 AND 5 AND n_tx_last_1h >= 6 AND distinct_countries_last_24h >= 2 THEN 'card_testing'
  WHEN channel = 'ATM' AND amount BETWEEN 400 AND 950 AND merchant_mcc = '6011' AND n_tx_last_1h BETWEEN 2 AND 5 THEN 'cashout'
  WHEN channel = 'ECOM' AND merchant_mcc IN ('7995', '5967') AND amount BETWEEN 100 AND 800 THEN 'high_risk_mcc'
  WHEN channel IN ('ECOM', 'POS') AND merchant_mcc IN ('5732', '5999')
    AND amount / nullif(amount_avg_30d, 0) BETWEEN 6 AND 15 THEN 'account_takeover'
  WHEN channel = 'ECOM' AND amount BETWEEN 80 AND 600 AND is_geo_mismatch = 1 AND distinct_countries_last_24h >= 2 THEN 'geo_anomaly'
  END AS attack_pattern FROM feat)"""

DECISION_COLUMNS = "transaction_id, fraud_probability, adjusted_probability, action, risk_score"
CONFUSION_COLUMNS = "tn, fp, fn, tp, precision, recall, f1"

ORACLES: dict[str, str] = {
    "features_matrix": BASE
    + "SELECT transaction_id, "
    + ", ".join(
        "round(amount_log, 9) AS amount_log" if name == "amount_log" else f"CAST({name} AS DOUBLE) AS {name}"
        for name in FEATURE_COLUMNS
    )
    + " FROM feat",
    "rule_hits": _with(TXN, FEATURES, HITS) + "SELECT transaction_id, code, severity FROM hits",
    "rule_hit_counts": _with(TXN, FEATURES, HITS) + "SELECT code, severity, count(*) AS n_hits FROM hits GROUP BY ALL",
    "rules_as_table": BASE
    + """SELECT * FROM (SELECT transaction_id, concat_ws('|', CASE WHEN amount >= 1000 THEN 'T01_LARGE' END,
      CASE WHEN amount >= 300 AND is_night = 1 THEN 'T02_LARGE_NIGHT' END, CASE WHEN card_age_days < 7 THEN 'T03_NEW_CARD' END,
      CASE WHEN n_tx_last_1h >= 5 AND is_geo_mismatch = 1 THEN 'T04_BURST_ABROAD' END,
      CASE WHEN amount_zscore_30d >= 6 THEN 'T05_OUTLIER' END) AS codes FROM feat) WHERE codes <> ''""",
    "rule_index_hits": BASE
    + f"""SELECT r.transaction_id, count(*) AS n_hits, max(t.transaction_id) AS last_code FROM feat r JOIN feat t
      ON r.amount >= t.amount AND r.amount < t.amount + {_d(1.0)} AND r.card_age_days < t.card_age_days + 30
      GROUP BY r.transaction_id""",
    "decisions": SCORED + f"SELECT {DECISION_COLUMNS}, reasons, rule_codes FROM scored",
    "decision_counts": SCORED + "SELECT action, count(*) AS n_rows FROM scored GROUP BY action",
    "decisions_skip_blocked": SCORED + f"SELECT {DECISION_COLUMNS} FROM scored",
    "decision_response": SCORED
    + "SELECT transaction_id, action, fraud_probability, risk_score, reasons, CAST(n_hits AS BIGINT) AS rule_hits, "
    "'fixed-1' AS model_version FROM scored",
    "output_violations": SCORED
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", count(*) FILTER (NOT coalesce({sql}, false)) AS n_violations FROM scored"
        for name, sql in {
            "probability_in_0_1": "fraud_probability BETWEEN 0 AND 1",
            "score_in_0_1000": "risk_score BETWEEN 0 AND 1000",
            "known_action": "action IN ('APPROVE', 'REVIEW', 'DECLINE')",
            "known_severity": "n_hits >= 0",
            "has_id": "transaction_id IS NOT NULL",
        }.items()
    ),
    "safe_output": SCORED
    + f"SELECT transaction_id, epoch_us(timestamp) AS timestamp, card_id, merchant_id, {DECISION_COLUMNS[16:]}, reasons, "
    "rule_codes AS rule_hits FROM scored",
    "audit_log": SCORED
    + "SELECT transaction_id, action, CAST(printf('%.4f', fraud_probability) AS DOUBLE) AS fraud_probability, risk_score, rule_codes FROM scored",
    "review_queue_topk": SCORED
    + "SELECT transaction_id, risk_score, adjusted_probability FROM scored WHERE action = 'REVIEW' "
    "ORDER BY risk_score DESC, transaction_id LIMIT 25",
    "contract_valid": _valid(ERROR_SQL),
    "contract_quarantine": _with(TXN, DIRTY)
    + "SELECT transaction_id, epoch_us(timestamp) AS timestamp, merchant_id, CAST("
    + " + ".join(f"CASE WHEN {sql} THEN 1 ELSE 0 END" for _, _, sql in ERROR_SQL)
    + f" AS BIGINT) AS n_errors, {_error_text(ERROR_SQL)} AS errors FROM dirty WHERE {_bad(ERROR_SQL)}",
    "contract_error_counts": _with(TXN, DIRTY)
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{field}' AS field, '{code}' AS code, count(*) AS n_rows FROM dirty WHERE {sql}" for field, code, sql in ERROR_SQL
    )
    + ") WHERE n_rows > 0",
    "contract_json_valid": _valid([*ERROR_SQL, NOTE_ERROR]),
    "contract_json_quarantine": _with(TXN, DIRTY)
    + f"SELECT event_id, {_error_text([*ERROR_SQL, NOTE_ERROR])} AS errors FROM dirty WHERE {_bad([*ERROR_SQL, NOTE_ERROR])}",
    "json_batch_explode": _with(TXN, DIRTY)
    + "SELECT event_id // 50 AS request, event_id % 50 AS pos, merchant_id, "
    + f"{_error_text([*ERROR_SQL, NOTE_ERROR])} AS errors FROM dirty",
    "velocity_windows": VELOCITY,
    "velocity_sweep": VELOCITY.replace(
        "FROM txn",
        "FROM (SELECT * REPLACE (CASE WHEN CAST(substr(transaction_id, 2) AS BIGINT) % 3 = 0 THEN 'HEAVY' ELSE card_id END AS card_id) FROM txn)",
    ),
    "customer_baseline": _with(TXN)
    + """SELECT customer_id, count(*) AS n_tx, CAST(sum(CAST(amount AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS avg_amount,
      round(coalesce(stddev_samp(amount), 0), 6) AS std_amount,
      CAST(date_diff('day', min(timestamp), max(timestamp)) AS INT) AS tenure_days, min(card_country) AS home_country
      FROM txn GROUP BY customer_id""",
    "first_seen_ages": _with(TXN)
    + """SELECT transaction_id,
      CAST(date_diff('day', min(timestamp) OVER (PARTITION BY customer_id), timestamp) AS INT) AS customer_age_days,
      CAST(date_diff('day', min(timestamp) OVER (PARTITION BY card_id), timestamp) AS INT) AS card_age_days FROM txn""",
    "asof_profile": _with(TXN)
    + """, daily AS (SELECT card_id, date_trunc('day', timestamp) AS day, count(*) AS n,
      sum(CAST(amount AS DECIMAL(18, 6))) AS s FROM txn GROUP BY ALL),
    profile AS (SELECT card_id, day + INTERVAL 1 DAY AS valid_from, CAST(sum(n) OVER w AS BIGINT) AS n_before,
      CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS avg_before FROM daily WINDOW w AS (PARTITION BY card_id ORDER BY day))
    SELECT transaction_id, n_before, avg_before FROM txn ASOF LEFT JOIN profile
      ON txn.card_id = profile.card_id AND txn.timestamp >= profile.valid_from""",
    "freshness": _with(TXN)
    + f"""SELECT channel, epoch_us(max(timestamp)) AS latest, count(*) AS n_rows,
      CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp)) AS DOUBLE) / {_d(3600000000.0)} AS age_hours,
      CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp)) AS DOUBLE) / {_d(3600000000.0)} > {_d(24.5)} AS is_stale
      FROM txn GROUP BY channel""",
    "card_bursts": BURSTS + "SELECT * FROM found",
    "time_split": _with(TXN, FEATURES, _split(0.2, 0.15)) + "SELECT transaction_id, split FROM parted",
    "split_summary": _with(TXN, FEATURES, _split())
    + """SELECT coalesce(split, 'all') AS split, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
      avg(is_fraud) AS fraud_rate FROM parted GROUP BY ROLLUP (split)""",
    "training_summary": _with(TXN, FEATURES, _split(0.2, 0.15))
    + """SELECT coalesce(split, 'all') AS split, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
      avg(is_fraud) AS fraud_rate FROM parted GROUP BY ROLLUP (split)""",
    "model_checks": _with(TXN, FEATURES, _split(0.2, 0.15))
    + """SELECT split, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_other_action,
      CAST(0 AS BIGINT) AS n_other_probability FROM parted GROUP BY split""",
    "model_freshness": "SELECT CAST(0 AS INT) AS age_days, false AS is_stale",
    "saved_split": _with(TXN, FEATURES, _split())
    + "SELECT transaction_id, amount, is_fraud, split FROM parted WHERE split = 'test'",
    "amount_histogram": BASE
    + """, ends AS (SELECT is_fraud, min(amount_log) AS low, (max(amount_log) - min(amount_log)) / 60 AS width, count(*) AS n
      FROM feat GROUP BY is_fraud)
    , bins AS (SELECT *, CAST(unnest(range(60)) AS INT) AS bin FROM ends),
    found AS (SELECT is_fraud, CAST(least(59, floor((amount_log - low) / width)) AS INT) AS bin, count(*) AS n_found
      FROM feat JOIN ends USING (is_fraud) GROUP BY ALL)
    SELECT is_fraud, bin, round(low + width * bin, 6) AS bin_start, coalesce(n_found, 0) AS n_rows,
      round(coalesce(n_found, 0) / (n * width), 6) AS density FROM bins LEFT JOIN found USING (is_fraud, bin)""",
    "attack_patterns": _with(TXN, FEATURES, ATTACK)
    + "SELECT transaction_id, attack_pattern FROM tagged WHERE attack_pattern IS NOT NULL",
    "pattern_share": _with(TXN, FEATURES, ATTACK)
    + """SELECT attack_pattern, count(*) AS n_rows, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM tagged
      WHERE is_fraud = 1 AND attack_pattern IS NOT NULL GROUP BY attack_pattern""",
    "class_means_lift": _with(TXN, FEATURES, _split(), _means("is_fraud", "0", "1", ("legit", "fraud")))
    + "SELECT feature, round(legit, 9) AS legit, round(fraud, 9) AS fraud, round(fraud / nullif(legit, 0), 2) AS lift FROM means",
    "split_drift_means": _with(TXN, FEATURES, _split(), _means("split", "'train'", "'test'", ("train_mean", "test_mean")))
    + "SELECT feature, round(train_mean, 9) AS train_mean, round(test_mean, 9) AS test_mean, "
    "round((test_mean - train_mean) / nullif(train_mean, 0) * 100, 2) AS rel_diff_pct FROM means",
    "hour_profile": BASE
    + """, counts AS (SELECT hour, count(*) FILTER (is_fraud = 0) AS n_legit, count(*) FILTER (is_fraud = 1) AS n_fraud
      FROM feat GROUP BY hour)
    SELECT *, CAST(n_legit AS DOUBLE) / sum(n_legit) OVER () AS legit_share,
      CAST(n_fraud AS DOUBLE) / sum(n_fraud) OVER () AS fraud_share FROM counts""",
    "geo_fraud_rate": BASE
    + """SELECT is_geo_mismatch, count(*) FILTER (is_fraud = 0) AS n_legit, count(*) FILTER (is_fraud = 1) AS n_fraud,
      round(avg(is_fraud), 4) AS fraud_rate FROM feat GROUP BY is_geo_mismatch""",
    "correlation": _correlation(),
    "auc_report": AUC,
    "auc_report_ranged": AUC,
    "precision_at_top": _with(TXN, FEATURES, _scored(), TOP) + "SELECT k, precision FROM top",
    "confusion": _with(TXN, FEATURES, _scored(), _confusion("scored")) + f"SELECT {CONFUSION_COLUMNS} FROM rates",
    "metrics_report": _with(TXN, FEATURES, _scored(), TOP, _confusion("scored"))
    + f", auc AS ({AUC.replace(SCORED, 'WITH ', 1).replace('WITH ' + chr(10) + ',', 'WITH ', 1)}) "
    + " UNION ALL ".join(
        [f"SELECT '{new}' AS metric, CAST({old} AS DOUBLE) AS value FROM auc" for new, old in REPORT_NAMES.items()]
        + ["SELECT 'precision_at_top_1pct' AS metric, round(precision, 9) AS value FROM top"]
        + [f"SELECT '{new}' AS metric, round(CAST({old} AS DOUBLE), 9) AS value FROM rates" for new, old in RATE_NAMES.items()]
    ),
    "training_stats": _with(TXN, FEATURES, _split(), TRAIN_STATS)
    + "SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std, round(p01, 9) AS p01, round(p99, 9) AS p99 FROM stats",
    "threshold_sweep": _sweep(),
    "shadow_compare": _with(TXN, FEATURES, _scored(), _scored("other", -3.5))
    + """SELECT scored.action AS live_action, other.action AS shadow_action, count(*) AS n_rows,
      CAST(sum(other.risk_score - scored.risk_score) AS BIGINT) AS score_shift
      FROM scored JOIN other USING (transaction_id) GROUP BY ALL""",
    "weekly_recall": SCORED
    + f"""
, weeks AS (SELECT date_trunc('week', timestamp) AS t, count(*) FILTER (is_fraud = 1) AS n_fraud,
  count(*) FILTER (is_fraud = 1 AND p >= {_d(0.5)}) AS n_caught FROM scored GROUP BY 1),
rated AS (SELECT *, coalesce(CAST(n_caught AS DOUBLE) / nullif(n_fraud, 0), 0) AS recall FROM weeks),
lagged AS (SELECT *, lag(recall) OVER (ORDER BY t) AS recall_before FROM rated)
SELECT strftime(t, '%Y-%m-%d') AS week, n_fraud, n_caught, recall, recall_before,
  coalesce(recall < recall_before * ({_d(1.0)} - {_d(0.05)}), false) AS dropped FROM lagged""",
    "matured_metrics": _with(
        TXN,
        FEATURES,
        _scored(),
        f"ready AS (SELECT * FROM scored WHERE timestamp <= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY)",
        _confusion("ready"),
    )
    + f"SELECT {CONFUSION_COLUMNS} FROM rates",
    "class_weights": _with(TXN)
    + """SELECT count(*) FILTER (is_fraud = 1) AS n_pos, count(*) FILTER (is_fraud = 0) AS n_neg,
      CAST(count(*) FILTER (is_fraud = 0) AS DOUBLE) / count(*) FILTER (is_fraud = 1) AS positive_weight FROM txn""",
    "psi_features": _with(TXN, FEATURES, _split(), _psi("split = 'train'", "split = 'test'", FEATURE_COLUMNS))
    + "SELECT feature, psi FROM psi",
    "psi_levels": _with(TXN, FEATURES, _split(), _psi("is_fraud = 0", "is_fraud = 1", FEATURE_COLUMNS))
    + "SELECT feature, psi, CASE WHEN psi > 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level FROM psi",
    "psi_span": _with(
        TXN,
        FEATURES,
        "parted AS (SELECT *, CASE WHEN d BETWEEN 9 AND 18 THEN 'old' WHEN d > 18 THEN 'new' ELSE 'none' END AS split FROM "
        "(SELECT *, epoch_us(timestamp) // 86400000000 - min(epoch_us(timestamp) // 86400000000) OVER () AS d FROM feat))",
        _psi("split = 'old'", "split = 'new'", FEATURE_COLUMNS),
    )
    + "SELECT feature, psi FROM psi",
    "psi_score": _with(TXN, FEATURES, _scored(), _split(source="(SELECT * EXCLUDE (fraud_probability), p AS fraud_probability FROM scored)"))
    + ", "
    + _psi("split = 'train'", "split = 'test'", ["fraud_probability"])
    + "SELECT feature, psi FROM psi",
    "drift_against_training": _with(TXN, FEATURES, _split(), TRAIN_STATS)
    + """SELECT feature, round(avg(value), 6) AS live_mean, round((avg(value) - mean) / std, 6) AS z,
      round(avg(CASE WHEN value BETWEEN p01 AND p99 THEN 0 ELSE 1 END), 6) AS share_outside
      FROM long JOIN stats USING (feature) WHERE split = 'test' GROUP BY feature, mean, std""",
    # The monotone fit by its min-max form, over all pairs of scores.
    "isotonic_fit": SCORED
    + """, points AS (SELECT floor(p * CAST(1000.0 AS DOUBLE)) / CAST(1000.0 AS DOUBLE) AS score,
      CAST(sum(is_fraud) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS weight FROM scored GROUP BY 1),
    sums AS (SELECT *, row_number() OVER o AS i, sum(total) OVER o AS t, sum(weight) OVER o AS w FROM points WINDOW o AS (ORDER BY score)),
    means AS (SELECT a.i AS j, b.i AS k, (b.t - a.t + a.total) / (b.w - a.w + a.weight) AS mean FROM sums a JOIN sums b ON a.i <= b.i),
    least AS (SELECT k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS m FROM means),
    fitted AS (SELECT i, round(max(m), 9) AS fitted FROM least GROUP BY i)
    SELECT min(score) AS low, max(score) AS high, fitted, CAST(sum(weight) AS BIGINT) AS n_rows
    FROM sums JOIN fitted USING (i) GROUP BY fitted""",
    # Newton's steps, a fixed number of them.
    "sigmoid_fit": "WITH RECURSIVE "
    + ", ".join([TXN, FEATURES, _scored()])
    + """, points AS (SELECT floor(p * CAST(1000.0 AS DOUBLE)) / CAST(1000.0 AS DOUBLE) AS score,
      CAST(sum(is_fraud) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS weight FROM scored GROUP BY 1),
    steps AS (
      SELECT 0 AS step, CAST(0 AS DOUBLE) AS slope, CAST(0 AS DOUBLE) AS intercept
      UNION ALL
      SELECT step + 1, slope + (g1 * h - g0 * hx) / (hxx * h - hx * hx), intercept + (g0 * hxx - g1 * hx) / (hxx * h - hx * hx)
      FROM (SELECT step, slope, intercept, sum((total - weight * f) * score) AS g1, sum(total - weight * f) AS g0,
          sum(weight * f * (1 - f) * score * score) AS hxx, sum(weight * f * (1 - f) * score) AS hx, sum(weight * f * (1 - f)) AS h
        FROM (SELECT *, 1 / (1 + exp(-(slope * score + intercept))) AS f FROM steps, points WHERE step < 30)
        GROUP BY step, slope, intercept))
    SELECT score, round(1 / (1 + exp(-(slope * score + intercept))), 6) AS fitted FROM points, steps WHERE step = 30""",
    "drift_against_saved": _with(TXN, FEATURES, _split(0.2, 0.15), TRAIN_STATS.replace("'train'", "'fit'"))
    + """SELECT feature, round(avg(value), 6) AS live_mean, round((avg(value) - mean) / std, 6) AS z,
      round(avg(CASE WHEN value BETWEEN p01 AND p99 THEN 0 ELSE 1 END), 6) AS share_outside
      FROM long JOIN stats USING (feature) WHERE split = 'test' GROUP BY feature, mean, std""",
    "probability_histogram": SCORED
    + " UNION ALL ".join(
        [
            f"SELECT '{bound}' AS le, count(*) FILTER (fraud_probability <= {_d(bound)}) AS n_rows, "
            "round(sum(fraud_probability), 4) AS score_sum FROM scored"
            for bound in PROBABILITY_BOUNDS
        ]
        + ["SELECT '+Inf' AS le, count(*) AS n_rows, round(sum(fraud_probability), 4) AS score_sum FROM scored"]
    ),
    "decline_rate_daily": _decline("day"),
    "decline_rate_hourly": _decline("hour"),
    "decline_by_country": SCORED
    + """, countries AS (SELECT card_country, count(*) AS n_rows, count(*) FILTER (action = 'DECLINE') AS n_declined,
      CAST(count(*) FILTER (action = 'DECLINE') AS DOUBLE) / count(*) AS decline_rate FROM scored GROUP BY card_country),
    zs AS (SELECT *, coalesce((decline_rate - avg(decline_rate) OVER ()) / nullif(stddev_samp(decline_rate) OVER (), 0), 0) AS z
      FROM countries)
    SELECT card_country, n_rows, n_declined, decline_rate, round(z, 6) AS z, abs(z) > 2 AS is_outlier FROM zs""",
    "silent_rules": _with(TXN, FEATURES, HITS, CODES)
    + """, known AS (SELECT * FROM codes UNION ALL SELECT 'R099_NEVER', 'INFO')
    SELECT known.code, known.severity, count(hits.code) AS n_hits, count(hits.code) = 0 AS is_silent
    FROM known LEFT JOIN hits ON known.code = hits.code GROUP BY ALL""",
    "rule_activity": _with(TXN, FEATURES, HITS, CODES)
    + f""", totals AS (SELECT date_trunc('day', timestamp) AS t, count(*) AS n_rows FROM feat GROUP BY 1),
    counted AS (SELECT date_trunc('day', timestamp) AS t, code, count(*) AS n FROM hits GROUP BY ALL),
    filled AS (SELECT t, codes.code, n_rows, coalesce(n, 0) AS n_hits FROM totals CROSS JOIN codes LEFT JOIN counted
      ON counted.t = totals.t AND counted.code = codes.code),
    rated AS (SELECT *, CAST(n_hits AS DOUBLE) / n_rows AS hit_rate FROM filled),
    lagged AS (SELECT *, lag(hit_rate) OVER (PARTITION BY code ORDER BY t) AS rate_before FROM rated)
    SELECT strftime(t, '%Y-%m-%d') AS period, code, n_hits, hit_rate, rate_before, n_hits = 0 AS is_silent,
      coalesce(rate_before > 0 AND hit_rate >= rate_before * {_d(1.5)}, false) AS is_noisy FROM lagged""".replace(
        "SELECT t, codes.code", "SELECT totals.t, codes.code"
    ),
    "rule_backtest": _backtest(),
    "stream_scores": SCORED + f"SELECT {DECISION_COLUMNS}, reasons FROM scored",
    "stream_payload_scores": _with(TXN, FEATURES, _scored(), DIRTY)
    + f""", bad AS (SELECT event_id, {_bad([*ERROR_SQL, NOTE_ERROR])} AS refused FROM dirty)
    SELECT CASE WHEN refused THEN 'QUARANTINE' ELSE action END AS outcome, count(*) AS n_rows
    FROM scored JOIN bad ON CAST(substr(transaction_id, 2) AS BIGINT) = event_id GROUP BY 1""",
    "json_text_errors": _with(TXN, DIRTY)
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{field}' AS field, '{code}' AS code, count(*) AS n_rows FROM dirty WHERE {sql}"
        for field, code, sql in [*ERROR_SQL, NOTE_ERROR]
    )
    + ") WHERE n_rows > 0",
    "stream_late_rows": _with(TXN)
    + """, numbered AS (SELECT *, CAST(substr(transaction_id, 2) AS BIGINT) % 3 AS batch_id FROM txn),
    newest AS (SELECT batch_id, max(epoch_us(timestamp)) AS m FROM numbered GROUP BY batch_id),
    marked AS (SELECT batch_id, max(m) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000
      AS watermark_micros FROM newest),
    sided AS (SELECT *, coalesce(epoch_us(timestamp) < watermark_micros, false) AS late FROM numbered JOIN marked USING (batch_id)),
    lates AS (SELECT batch_id, count(*) FILTER (late) AS n_late FROM sided GROUP BY batch_id)
    SELECT batch_id, CASE WHEN late THEN 'late' ELSE 'on_time' END AS side, count(*) AS n_rows, max(transaction_id) AS last_id,
      watermark_micros, n_late FROM sided JOIN lates USING (batch_id) GROUP BY ALL""",
    "stream_confirmed": _with(TXN)
    + """SELECT transaction_id, is_fraud = 1 AND CAST(substr(transaction_id, 2) AS BIGINT) % 2 = 0 AS confirmed FROM txn
      WHERE timestamp <= (SELECT max(timestamp) FROM txn) - INTERVAL 14 DAY""",
    "stream_dedup": _with(TXN) + "SELECT transaction_id, amount FROM txn",
    "stream_decision_windows": _stream_windows(1, 1),
    "stream_sliding_windows": _stream_windows(2, 1),
    "stream_rule_hits": _with(TXN, FEATURES, HITS)
    + """SELECT epoch_us(date_trunc('day', timestamp)) AS window_micros, code, severity, count(*) AS n_hits
      FROM hits GROUP BY ALL""",
    "stream_sessions": BURSTS
    + """SELECT card_id, started_micros, n_tx, total_amount FROM found
      WHERE ended_micros + 600000000 <= (SELECT max(epoch_us(timestamp)) // 1000 * 1000 FROM txn)""",
    "stream_velocity": VELOCITY,
    "stream_drift": _with(TXN, FEATURES, "parted AS (SELECT *, 'all' AS split FROM feat)")
    + ", "
    + _psi("is_fraud = 0", "true", ["amount", "amount_log", "amount_zscore_30d", "velocity_score", "hour"])
    + "SELECT feature, psi FROM psi",
}
