"""The derived data and its preparation as plain SQL for an independent engine.

Written from the rules, not from the Spark code; the parts are common table
expressions that the checks put together with ``with_``.
"""

from __future__ import annotations

from ..functions.constants import ALL_STATES, INDUSTRY_RANGES, KNOWN_MCCS, SPECIAL_TOKENS


def quoted(values) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


CAT_CASE = (
    "CASE " + " ".join(f"WHEN mcc_int BETWEEN {lo} AND {hi} THEN '{label}'" for lo, hi, label, _ in INDUSTRY_RANGES)
    + " ELSE 'GENERAL' END"
)
DISPLAY_CASE = (
    "CASE " + " ".join(f"WHEN {{c}} BETWEEN {lo} AND {hi} THEN '{shown} (' || {{c}} || ')'" for lo, hi, _, shown in INDUSTRY_RANGES)
    + " ELSE {c}::VARCHAR END"
)
CAT_LABELS = sorted({r[2] for r in INDUSTRY_RANGES}) + ["GENERAL"]
MCC_LABELS = sorted(str(m) for m in KNOWN_MCCS)
CHIP_LABELS = ["CHIP", "ONLINE", "SWIPE", "UNK"]
STATE_LABELS = sorted(ALL_STATES)


def bucket(x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE ('0x' || substr(md5({x}), 1, 8))::BIGINT % {n} END"


def log_bucket(x: str, n: int = 32) -> str:
    return f"least(floor({n} * ln(least(greatest({x}, 0), 315569519) + 1) / ln(315569520))::BIGINT + 1, {n - 1})"


CTES = {}
NEEDS = {}


def cte(name: str, body: str, needs: str = "") -> None:
    CTES[name] = body.strip()
    NEEDS[name] = needs.split()


def with_(names: str, select: str) -> str:
    """``WITH`` the named expressions and what they need, then ``select``."""
    seen: list[str] = []

    def visit(n):
        for d in NEEDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in seen) + "\n" + select.strip()


cte("v_card", """
SELECT o_orderkey AS row_id, o_custkey AS "User", (o_orderkey % 4)::INT AS "Card",
  year(o_orderdate)::INT AS "Year",
  (CASE WHEN o_orderkey % 1009 = 0 THEN 2 ELSE month(o_orderdate) END)::INT AS "Month",
  (CASE WHEN o_orderkey % 1009 = 0 THEN 30 ELSE day(o_orderdate) END)::INT AS "Day",
  CASE WHEN o_orderkey % 503 <> 0 THEN lpad((o_orderkey * 7 % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey * 13 % 60)::VARCHAR, 2, '0') END AS "Time",
  (CASE WHEN o_orderkey % 97 = 0 THEN '$-' ELSE '$' END)
    || (CASE WHEN c // 100 >= 1000 THEN (c // 100000)::VARCHAR || ',' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') ELSE (c // 100)::VARCHAR END)
    || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS "Amount",
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Swipe Transaction' WHEN '2' THEN 'Swipe Transaction' WHEN '3' THEN 'Chip Transaction'
    WHEN '4' THEN 'Online Transaction' ELSE 'Manual' END AS "Use Chip",
  'Merchant #' || (o_orderkey % 997) AS "Merchant Name",
  'City ' || (o_custkey % 37) AS "Merchant City",
  CASE c_nationkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN ' ny ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'ONLINE' END AS "Merchant State",
  CASE WHEN o_custkey % 11 <> 0 THEN (10000 + o_custkey * 37 % 89999) || '.0' END AS "Zip",
  (CASE o_orderkey % 7 WHEN 0 THEN 5411 WHEN 1 THEN 5812 WHEN 2 THEN 3000 WHEN 3 THEN 7995 WHEN 4 THEN 9402 WHEN 5 THEN 1234 END)::INT AS "MCC",
  CASE WHEN o_orderkey % 53 = 0 THEN 'Yes' WHEN o_orderkey % 107 = 0 THEN '1' ELSE 'No' END AS "Is Fraud?"
FROM (SELECT *, o_orderkey * 7919 % 600000 AS c FROM orders) JOIN customer ON o_custkey = c_custkey
""")
cte("v_dated", """
SELECT *, TRY_CAST("Year" || '-' || lpad("Month"::VARCHAR, 2, '0') || '-' || lpad("Day"::VARCHAR, 2, '0') AS DATE) AS date FROM v_card
""", "v_card")
cte("daily", "SELECT date, count(*) AS n FROM v_dated WHERE date IS NOT NULL GROUP BY date", "v_dated")
cte("running", "SELECT *, sum(n) OVER (ORDER BY date) AS cumulative, sum(n) OVER () AS total FROM daily", "daily")
cte("cutoffs", """
SELECT min(date) FILTER (cumulative >= total * 0.8::DOUBLE) AS c1,
  min(date) FILTER (cumulative >= total * (0.8::DOUBLE + 0.1::DOUBLE)) AS c2 FROM running
""", "running")
cte("v_split", """
SELECT v_dated.*, CASE WHEN date < c1 THEN 'train' WHEN date < c2 THEN 'val' ELSE 'test' END AS split
FROM v_dated, cutoffs WHERE date IS NOT NULL
""", "v_dated cutoffs")
cte("v_target", """SELECT *, ("Is Fraud?" IN ('Yes', '1'))::INT AS y FROM v_split""", "v_split")


def _clean(source: str, extra: str = "") -> str:
    return f"""
SELECT row_id, {extra} "User" AS "user", least(greatest("Card", 0), 9) AS card,
  TRY_CAST(replace(replace("Amount", '$', ''), ',', '') AS DOUBLE) AS amt_num,
  regexp_replace(upper("Merchant Name"), '[^A-Z0-9\\s\\-]', '', 'g') AS merch_clean,
  coalesce("MCC", -1) AS mcc_int, upper("Use Chip") AS chip_upper,
  lpad(substr(replace(coalesce("Zip", '00000'), '.0', ''), 1, 3), 3, '0')::INT AS zip3,
  coalesce(nullif(trim(upper("Merchant State")), ''), 'XX') AS state_clean,
  least(greatest("User", 0), 2999) AS cust,
  TRY_CAST("Year" || '-' || lpad("Month"::VARCHAR, 2, '0') || '-' || lpad("Day"::VARCHAR, 2, '0') || ' ' || coalesce("Time", '00:00') AS TIMESTAMP) AS ts
FROM {source}
"""


def _prepared(source: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY ts ASC NULLS LAST, row_id)"
    return f"""
SELECT *, coalesce(hour(ts), 0) AS hour, coalesce(isodow(ts) - 1, 0) AS dow, coalesce(month(ts), 1) AS month,
  {bucket("merch_clean", 2000)} AS merch_hash,
  row_number() OVER {w} - 1 AS pos,
  greatest(coalesce(epoch(ts) - lag(epoch(ts)) OVER {w}, 0), 0)::DOUBLE AS time_delta_s
FROM {source}
"""


AMT_INDEX = " + ".join(f"(amt_num >= {t})::INT" for t in (10, 50, 100, 500, 1000, 5000))


def _indexed(source: str) -> str:
    return f"""
SELECT *, coalesce({AMT_INDEX}, 0) AS i_amt, merch_hash AS i_merch,
  list_position([{quoted(CAT_LABELS)}], {CAT_CASE}) - 1 AS i_cat,
  list_position([{quoted(MCC_LABELS)}], CASE WHEN mcc_int::VARCHAR IN ({quoted(MCC_LABELS)}) THEN mcc_int::VARCHAR ELSE '-1' END) - 1 AS i_mcc,
  hour AS i_hour, dow AS i_dow, month - 1 AS i_month, card AS i_card,
  CASE chip_upper WHEN 'CHIP TRANSACTION' THEN 0 WHEN 'ONLINE TRANSACTION' THEN 1 WHEN 'SWIPE TRANSACTION' THEN 2 ELSE 3 END AS i_chip,
  zip3 AS i_zip,
  list_position([{quoted(STATE_LABELS)}], CASE WHEN state_clean IN ({quoted(STATE_LABELS)}) THEN state_clean ELSE 'XX' END) - 1 AS i_state,
  cust AS i_cust
FROM {source}
"""


# name, index column, number of tokens, token text
CARD_STEPS = [
    ("AMT", "i_amt", 7, "'AMT_' || i_amt"),
    ("MERCH", "i_merch", 2000, "'MERCH_' || i_merch"),
    ("CAT", "i_cat", len(CAT_LABELS), f"'CAT_' || [{quoted(CAT_LABELS)}][i_cat + 1]"),
    ("MCC", "i_mcc", len(MCC_LABELS), f"'MCC_' || [{quoted(MCC_LABELS)}][i_mcc + 1]"),
    ("HOUR", "i_hour", 24, "'HOUR_' || lpad(i_hour::VARCHAR, 2, '0')"),
    ("DOW", "i_dow", 7, "'DOW_' || i_dow"),
    ("MONTH", "i_month", 12, "'MONTH_' || lpad((i_month + 1)::VARCHAR, 2, '0')"),
    ("CARD", "i_card", 10, "'CARD_' || i_card"),
    ("CHIP", "i_chip", 4, f"'CHIP_' || [{quoted(CHIP_LABELS)}][i_chip + 1]"),
    ("ZIP3", "i_zip", 1000, "'ZIP3_' || lpad(i_zip::VARCHAR, 3, '0')"),
    ("STATE", "i_state", len(STATE_LABELS), f"'STATE_' || [{quoted(STATE_LABELS)}][i_state + 1]"),
    ("CUST", "i_cust", 3000, "'CUST_' || i_cust"),
]
CARD_OFFSETS = {}
_at = len(SPECIAL_TOKENS)
for _name, _, _size, _ in CARD_STEPS:
    CARD_OFFSETS[_name] = _at
    _at += _size
CARD_IDS = ", ".join(f"{i} + {CARD_OFFSETS[n]}" for n, i, _, _ in CARD_STEPS)
CARD_TOKENS = ", ".join(f'{t} AS "tok_{n}"' for n, _, _, t in CARD_STEPS)
CARD_TEXT = "concat_ws(' ', " + ", ".join(t for _, _, _, t in CARD_STEPS) + ")"

cte("card_clean", _clean("v_card"), "v_card")
cte("card_pre", _prepared("card_clean", '"user", card'), "card_clean")
cte("card_idx", _indexed("card_pre"), "card_pre")
cte("card_txt", f"SELECT *, {CARD_TEXT} AS txn_text FROM card_idx", "card_idx")
cte("card_seq", """
SELECT "user", card, (pos // 5)::INT AS chunk_id, count(*) AS n_txns,
  '<bos> ' || string_agg(txn_text, ' <sep> ' ORDER BY pos) || ' <eos>' AS text
FROM card_txt GROUP BY ALL
""", "card_txt")
cte("split_clean", _clean("v_split", "split,"), "v_split")
cte("split_pre", _prepared("split_clean", 'split, "user", card'), "split_clean")
cte("split_idx", _indexed("split_pre"), "split_pre")
cte("split_seq", f"""
SELECT split, "user", card, (pos // 5)::INT AS chunk_id, count(*) AS n_txns,
  '<bos> ' || string_agg({CARD_TEXT}, ' <sep> ' ORDER BY pos) || ' <eos>' AS text
FROM split_idx GROUP BY ALL
""", "split_idx")

cte("v_txn", """
SELECT 'u' || user_id AS user_id, (user_id % 5 = 0)::INT AS label,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq_order,
  ' addr_' || (event_id % 11) AS issuer_addr, 'bank_' || (event_id % 5) AS issuer_bank,
  ['普', '金', '白', '钻', 'X'][event_id % 5 + 1] AS card_level,
  year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minutes, second(ts)::INT AS seconds,
  epoch(ts) AS unix_ts, 'saddr_' || (event_id % 13) AS acq_addr, 'sbank_' || (event_id % 3) AS acq_bank,
  event_type AS txn_code, 'ch_' || (event_id % 4) AS channel, 'pos_' || (event_id % 6) AS pos_input, 'resp_' || (event_id % 9) AS resp_code,
  'mcc_' || (event_id % 17) AS merch_type, ['直', '间', '?'][event_id % 3 + 1] AS conn_mode, 'Shop #' || (event_id % 23) AS merch_name,
  CASE WHEN event_id % 10 = 0 AND a >= 1000 THEN (a // 1000) || ',' || lpad((a % 1000)::VARCHAR, 3, '0') ELSE a::VARCHAR END AS amount
FROM (SELECT *, event_id * 31 % 100000 AS a FROM events)
UNION ALL VALUES
  ('u-nolabel', NULL, 0, 'addr_1', 'bank_1', '普', 2024, 1, 9, 9, 5, 0, 1704791100.0::DOUBLE, 'saddr_1', 'sbank_1', 'view', 'ch_1', 'pos_1', 'resp_1', 'mcc_1', '直', 'Shop #1', '250'),
  ('u-cjk', 0, 0, 'addr_2', 'bank_2', '金', 2024, 1, 10, 23, 59, 59, 1704931199.0::DOUBLE, 'saddr_2', 'sbank_2', 'click', 'ch_2', 'pos_2', 'resp_2', 'mcc_2', '间', '支付宝-转账/**华', '1,250')
""")
cte("v_rows", """
SELECT *, (isodow(make_date(year, month, day)) - 1)::INT AS dow,
  (CASE WHEN hour < 6 THEN 0 WHEN hour < 12 THEN 1 WHEN hour < 18 THEN 2 ELSE 3 END)::INT AS period FROM v_txn
""", "v_txn")
cte("time_cuts", "SELECT quantile_cont(unix_ts, 0.8) AS q1, quantile_cont(unix_ts, 0.9) AS q2 FROM v_txn", "v_txn")
cte("v_rows_split", """
SELECT v_rows.*, CASE WHEN unix_ts <= q1 THEN 'train' WHEN unix_ts <= q2 THEN 'val' ELSE 'test' END AS split FROM v_rows, time_cuts
""", "v_rows time_cuts")


def _nd_clean(source: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY seq_order)"
    return f"""
SELECT * EXCLUDE (amount, merch_name, issuer_addr, issuer_bank, acq_addr, acq_bank),
  replace(amount, ',', '')::DOUBLE AS amount,
  regexp_replace(upper(merch_name), '[^A-Z0-9一-鿿\\s\\-/]', '', 'g') AS merch_name,
  trim(upper(issuer_addr)) AS issuer_addr, trim(upper(issuer_bank)) AS issuer_bank,
  trim(upper(acq_addr)) AS acq_addr, trim(upper(acq_bank)) AS acq_bank,
  row_number() OVER {w} - 1 AS pos,
  greatest(coalesce(unix_ts - lag(unix_ts) OVER {w}, 0), 0) AS time_delta_s
FROM {source}
"""


LEARNED = [("merch_type", "MCC"), ("txn_code", "TRXCODE"), ("channel", "CHANNEL"), ("pos_input", "POSINPUT"), ("resp_code", "RESPCODE")]


def _known(column: str, fit: str) -> str:
    return f"CASE WHEN {column} IN (SELECT {column} FROM {fit}) THEN {column} ELSE 'UNK' END"


def _nd_tokens(fit: str) -> list[tuple[str, str]]:
    """(prefix, token text) in step order."""
    lab = dict((c, p) for c, p in LEARNED)
    known = lambda c: f"'{lab[c]}_' || {_known(c, fit)}"
    amt = f"least(len(list_filter((SELECT e FROM {fit}_edges)[2:], lambda z: z <= amount + 1e-8)), 19)"
    return [
        ("AMT", f"'AMT_' || {amt}"),
        ("MERCH_NAME", f"'MERCH_NAME_' || ({bucket('merch_name', 4000)})"),
        ("MCC", known("merch_type")),
        ("CARDLVL", "'CARDLVL_' || CASE WHEN card_level IN ('普', '金', '白', '钻') THEN card_level ELSE 'UNK' END"),
        ("TRXCODE", known("txn_code")), ("CHANNEL", known("channel")), ("POSINPUT", known("pos_input")), ("RESPCODE", known("resp_code")),
        ("CONNMODE", "'CONNMODE_' || CASE WHEN conn_mode IN ('直', '间') THEN conn_mode ELSE 'UNK' END"),
        ("FAKA_ADDR", f"'FAKA_ADDR_' || ({bucket('issuer_addr', 4000)})"),
        ("SHOUDAN_ADDR", f"'SHOUDAN_ADDR_' || ({bucket('acq_addr', 4000)})"),
        ("FAKA_BANK", f"'FAKA_BANK_' || ({bucket('issuer_bank', 4000)})"),
        ("SHOUDAN_BANK", f"'SHOUDAN_BANK_' || ({bucket('acq_bank', 4000)})"),
        ("PERIOD", "'PERIOD_' || period"), ("DOW", "'DOW_' || dow"),
        ("TDIF", f"'TDIF_' || {log_bucket('time_delta_s')}"),
    ]


EDGE_PROBS = "[" + ", ".join(f"{i / 20}" for i in range(21)) + "]"
cte("nd_all", _nd_clean("v_rows", "user_id"), "v_rows")
cte("nd_all_edges", f"SELECT quantile_cont(amount, {EDGE_PROBS}) AS e FROM nd_all", "nd_all")
cte("nd_split", _nd_clean("v_rows_split", "split, user_id"), "v_rows_split")
cte("nd_train", "SELECT * FROM nd_split WHERE split = 'train'", "nd_split")
cte("nd_train_edges", f"SELECT quantile_cont(amount, {EDGE_PROBS}) AS e FROM nd_train", "nd_train")
ND_ALL = _nd_tokens("nd_all")
ND_TRAIN = _nd_tokens("nd_train")
cte("nd_tok", "SELECT *, " + ", ".join(f'{t} AS "tok_{p}"' for p, t in ND_ALL) + " FROM nd_all", "nd_all nd_all_edges")
cte("nd_split_txt", "SELECT split, user_id, label, pos, concat_ws(' ', " + ", ".join(t for _, t in ND_TRAIN) + ") AS txn_text FROM nd_split",
    "nd_split nd_train nd_train_edges")
cte("nd_seq", """
SELECT split, user_id, (pos // 20)::INT AS chunk_id, count(*) AS n_txns, max(label) AS label,
  '<bos> ' || string_agg(txn_text, ' <sep> ' ORDER BY pos) || ' <eos>' AS text
FROM nd_split_txt GROUP BY split, user_id, chunk_id
""", "nd_split_txt")
# Vocabulary of the nested-record route, ids in step order.
ND_LABELED = {"MCC": "merch_type", "TRXCODE": "txn_code", "CHANNEL": "channel", "POSINPUT": "pos_input", "RESPCODE": "resp_code"}
_parts = ["SELECT 0 AS step, unnest(range(5)) AS local_idx, unnest([" + quoted(SPECIAL_TOKENS) + "]) AS token"]
for _i, (_p, _) in enumerate(ND_ALL, 1):
    if _p in ND_LABELED:
        _c = ND_LABELED[_p]
        _parts.append(
            f"SELECT {_i}, row_number() OVER (ORDER BY v = 'UNK', v) - 1, '{_p}_' || v FROM "
            f"(SELECT DISTINCT {_c} AS v FROM nd_all UNION SELECT 'UNK')"
        )
    elif _p in ("CARDLVL", "CONNMODE"):
        _v = sorted(["普", "金", "白", "钻"] if _p == "CARDLVL" else ["直", "间"]) + ["UNK"]
        _parts.append(f"SELECT {_i}, unnest(range({len(_v)})), unnest([" + quoted(f"{_p}_{v}" for v in _v) + "])")
    else:
        _n = {"AMT": 20, "PERIOD": 4, "DOW": 7, "TDIF": 32}.get(_p, 4000)
        _parts.append(f"SELECT {_i}, r, '{_p}_' || r FROM range({_n}) t(r)")
cte("nd_vocab", "SELECT step, local_idx::INT AS local_idx, token, (row_number() OVER (ORDER BY step, local_idx) - 1)::INT AS global_id FROM ("
    + " UNION ALL ".join(_parts) + ")", "nd_all")
ND_ID_JOIN = " ".join(f'JOIN nd_vocab v{i} ON v{i}.token = "tok_{p}"' for i, (p, _) in enumerate(ND_ALL))
ND_ID_LIST = ", ".join(f"v{i}.global_id" for i in range(len(ND_ALL)))
cte("nd_ids", f"SELECT nd_tok.*, [1, {ND_ID_LIST}, 2] AS ids FROM nd_tok {ND_ID_JOIN}", "nd_tok nd_vocab")

cte("v_pred", """
SELECT 'u' || user_id AS "user", event_id, (event_id * 37 % 101) / 101.0::DOUBLE AS p1, (event_id % 7 = 0)::INT AS label,
  0.0::DOUBLE AS z0, (event_id % 41) / 10.0::DOUBLE - 2.0::DOUBLE AS z1, (event_id * 977 % 1000000)::DOUBLE AS amount FROM events
""")
cte("v_emb", """
SELECT vec_id AS row_id, CASE WHEN vec_id % 10 <= 7 THEN 'train' WHEN vec_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  (label = 0)::INT AS label, label AS group_id, embedding FROM embeddings
""")
SHUFFLE_KEY = "md5('42:' || {ids})"
