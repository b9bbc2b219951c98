"""ANSI SQL for the queries of the catalog, over the same tables.

Written from the definitions, not from the Spark plans: cells by UNION ALL, matches
by full joins or EXISTS, log collapse by window functions over whole rows.
"""

from __future__ import annotations

CYCLE = 883612800000000
RETENTION = 820454400000000
LOW = 1704844800000000
HIGH = 1705708800000000
DAY = 86400000000
AUDIT_AGE = 400 * DAY

PATH = "keyspace, column_family, row_key, super_column, column_name"
CELL = f"{PATH}, value, ts"
LIVE = "[-2147483648][-9223372036854775808][1]"


def _money(column: str, add: int = 0) -> str:
    amount = f"cast({column} AS decimal(18,2))"
    return f"cast({amount} + {add} AS varchar)" if add else f"cast({amount} AS varchar)"


def _cells(
    columns: dict[str, tuple[str, str]],
    source: str = "orders",
    super_rows: bool = False,
    where: str = "true",
) -> str:
    """One SELECT per column name, from (value, ts) expressions."""
    key = "o_custkey" if super_rows else "o_orderkey"
    family = "data_super" if super_rows else "data"
    super_column = "'order_' || o_orderkey" if super_rows else "CAST(NULL AS varchar)"
    parts = [
        f"SELECT 'usertable' AS keyspace, '{family}' AS column_family, "
        f"cast({key} AS varchar) AS row_key, {super_column} AS super_column, "
        f"'{name}' AS column_name, {value} AS value, {ts} AS ts FROM {source} "
        f"WHERE {where} AND {value} IS NOT NULL"
        for name, (value, ts) in columns.items()
    ]
    return " UNION ALL ".join(parts)


_TS = "epoch_us(o_orderdate)"
_STD = {
    "status": ("o_orderstatus", _TS),
    "price": (_money("o_totalprice"), _TS),
    "priority": ("o_orderpriority", _TS),
}
_OLD = {
    "status": ("CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END", _TS),
    "price": _STD["price"],
    "priority": _STD["priority"],
}
_NEW = {
    "status": ("o_orderstatus", f"{_TS} + CASE o_orderstatus WHEN 'P' THEN {DAY} ELSE 0 END"),
    "price": (
        f"CASE o_orderpriority WHEN '1-URGENT' THEN {_money('o_totalprice', 1)} "
        f"ELSE {_money('o_totalprice')} END",
        _TS,
    ),
    "priority": ("o_orderpriority", f"{_TS} + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END"),
}
_AUDIT_TS = (
    f"CASE o_orderstatus WHEN 'P' THEN {_TS} WHEN 'O' THEN {_TS} - {AUDIT_AGE} END"
)
_AUDIT_VALUE = f"CASE WHEN o_orderstatus IN ('P', 'O') THEN cast({_TS} AS varchar) END"
_AUDIT = _STD | {f"audit:{n}": (_AUDIT_VALUE, _AUDIT_TS) for n in _STD}

_BEFORE = "o_orderdate <= TIMESTAMP '1998-01-01'"
_KEPT = "o_orderdate >= TIMESTAMP '1996-01-01'"

CELLS_STD = _cells(_STD)
CELLS_SUPER = _cells(_STD, super_rows=True)
SNAP_OLD = _cells(_OLD, where=_BEFORE)
SNAP_NEW = _cells(_NEW, where=_KEPT)
SNAP_OLD_SUPER = _cells(_OLD, super_rows=True, where=_BEFORE)
SNAP_NEW_SUPER = _cells(_NEW, super_rows=True, where=_KEPT)
AUDIT = _cells(_AUDIT)
AUDIT_SUPER = _cells(_AUDIT, super_rows=True)

_NUMBER = "regexp_extract(props, '([0-9]+)', 1)"
_FIELD = f"'field' || right({_NUMBER}, 1)"
_DAY = "strftime(ts, '%Y-%m-%d')"
_USER = "cast(user_id AS varchar)"

VERSIONS = f"""SELECT 'usertable' AS keyspace, 'data' AS column_family, {_USER} AS row_key,
    CAST(NULL AS varchar) AS super_column, event_type AS column_name,
    {_money('value')} AS value, epoch_us(ts) AS ts FROM events"""

TRACKING_ENTRIES = f"""SELECT 'usertable' AS keyspace, 'dataTracking' AS column_family,
    {_USER} AS row_key,
    CASE event_type WHEN 'click' THEN 'up_new' WHEN 'purchase' THEN 'up_new'
      WHEN 'signup' THEN 'ins' WHEN 'error' THEN 'del' ELSE 'up_old' END AS state,
    {_FIELD} AS column_name, {_money('value')} AS value, epoch_us(ts) AS ts FROM events"""

TRACKING = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
    (PARTITION BY row_key, state, column_name ORDER BY ts DESC, value DESC) AS rn
    FROM ({TRACKING_ENTRIES})) WHERE rn = 1"""

_MOMENT = "(epoch_us(ts) - epoch_us(ts) % 21600000000)"
MUTATIONS = f"""SELECT 'usertable' AS keyspace, 'data' AS column_family,
    {_USER} || '@' || {_DAY} AS row_key, CAST(NULL AS varchar) AS super_column,
    CASE WHEN event_type = 'error' AND cast({_NUMBER} AS int) < 10 THEN NULL
      ELSE {_FIELD} END AS column_name,
    CASE event_type WHEN 'error' THEN 'del' ELSE 'ins' END AS op,
    CASE WHEN event_type = 'error' AND cast({_NUMBER} AS int) < 10 THEN NULL
      ELSE {_money('value')} END AS value,
    {_MOMENT} AS ts, event_id AS seq FROM events"""

MUTATIONS_SUPER = f"""SELECT 'usertable' AS keyspace, 'data_super' AS column_family,
    {_USER} AS row_key,
    CASE WHEN event_type = 'error' AND cast({_NUMBER} AS int) < 2 THEN NULL
      ELSE {_DAY} END AS super_column,
    CASE WHEN event_type = 'error' AND cast({_NUMBER} AS int) < 10 THEN NULL
      ELSE {_FIELD} END AS column_name,
    CASE event_type WHEN 'error' THEN 'del' ELSE 'ins' END AS op,
    CASE WHEN event_type = 'error' AND cast({_NUMBER} AS int) < 10 THEN NULL
      ELSE {_money('value')} END AS value,
    {_MOMENT} AS ts, event_id AS seq FROM events"""

_CHANGE = f"op, {CELL}"


def _scan(cells: str) -> str:
    return f"SELECT 'upsert' AS op, {CELL} FROM ({cells}) WHERE ts > {CYCLE}"


def _differential(old: str, new: str) -> str:
    both = ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in CELL.split(", "))
    return f"""WITH o AS ({old}), n AS ({new})
    SELECT CASE WHEN o.row_key IS NULL THEN 'ins' WHEN n.row_key IS NULL THEN 'del'
      ELSE 'upd' END AS op, {both}
    FROM o FULL JOIN n ON o.keyspace = n.keyspace AND o.column_family = n.column_family
      AND o.row_key = n.row_key AND o.column_name = n.column_name
      AND coalesce(o.super_column, '') = coalesce(n.super_column, '')
    WHERE o.row_key IS NULL OR n.row_key IS NULL
      OR o.ts IS DISTINCT FROM n.ts OR o.value IS DISTINCT FROM n.value"""


def _last(cells: str) -> str:
    return f"""SELECT {CELL} FROM (SELECT *, row_number() OVER
      (PARTITION BY {PATH} ORDER BY ts DESC, value DESC) AS rn FROM ({cells})) WHERE rn = 1"""


def _one_side(source: str, other: str, op: str) -> str:
    return f"""WITH a AS ({source}), b AS ({other})
    SELECT '{op}' AS op, {CELL} FROM a WHERE NOT EXISTS (SELECT 1 FROM b
      WHERE b.row_key = a.row_key AND b.column_name = a.column_name)"""


def _audit(cells: str) -> str:
    """Effective and audit time of a path side by side, by conditional aggregates."""
    path = "keyspace, column_family, row_key, super_column"
    plain = "CASE WHEN starts_with(column_name, 'audit:') THEN substr(column_name, 7) ELSE column_name END"
    return f"""SELECT CASE WHEN ts = audit_ts THEN 'ins' WHEN audit_ts < {CYCLE} THEN 'upd'
      ELSE 'ins' END AS op, {CELL}
    FROM (SELECT {path}, {plain} AS column_name,
        max(value) FILTER (NOT starts_with(column_name, 'audit:')) AS value,
        max(ts) FILTER (NOT starts_with(column_name, 'audit:')) AS ts,
        coalesce(max(ts) FILTER (starts_with(column_name, 'audit:')), 0) AS audit_ts
      FROM ({cells}) GROUP BY ALL)
    WHERE ts > {CYCLE} AND (ts = audit_ts OR (ts > audit_ts AND audit_ts <> {CYCLE}))"""


def _audit_wide() -> str:
    """One SELECT per column straight over the orders, which have both times."""
    audit = f"coalesce({_AUDIT_TS}, 0)"
    op = f"""CASE WHEN {_TS} = {audit} THEN 'ins' WHEN {audit} < {CYCLE} THEN 'upd' ELSE 'ins' END"""
    return " UNION ALL ".join(
        f"""SELECT {op} AS op, 'usertable' AS keyspace, 'data' AS column_family,
        cast(o_orderkey AS varchar) AS row_key, CAST(NULL AS varchar) AS super_column,
        '{name}' AS column_name, {value} AS value, {_TS} AS ts FROM orders
        WHERE {value} IS NOT NULL AND {_TS} > {CYCLE}
          AND ({_TS} = {audit} OR ({_TS} > {audit} AND {audit} <> {CYCLE}))"""
        for name, (value, _) in _STD.items()
    )


def _audit_bootstrap(cells: str) -> str:
    names = "keyspace, column_family, row_key, super_column"
    return f"""WITH c AS ({cells}) SELECT {CELL} FROM c UNION ALL
    SELECT {names}, 'audit:' || column_name, cast(ts AS varchar),
      CASE WHEN ts <= {CYCLE} THEN ts ELSE {CYCLE} - 900 END FROM c"""


def _split(cells: str) -> str:
    return f"""SELECT keyspace, column_family, row_key, super_column,
    CASE WHEN column_name LIKE 'audit:%' THEN substr(column_name, 7) ELSE column_name END
      AS column_name, value, ts, column_name LIKE 'audit:%' AS is_audit FROM ({cells})"""


def _log(mutations: str, mode: str, scope: str = "row") -> str:
    """Rows whole, by windows: deletion time, tombstones, newest two of each cell."""
    row = "PARTITION BY keyspace, column_family, row_key"
    key_deletion = "op = 'del' AND column_name IS NULL"
    if scope == "super":
        own = f"""greatest(
          max(CASE WHEN {key_deletion} AND super_column IS NULL THEN ts END) OVER ({row}),
          max(CASE WHEN {key_deletion} AND super_column IS NOT NULL THEN ts END)
            OVER ({row}, super_column))"""
    else:
        own = f"max(CASE WHEN {key_deletion} THEN ts END) OVER ({row})"
    dead = "n > 1 AND op = 'ins' AND ts < d" if mode == "classified" else "false"
    op = (
        "CASE WHEN n > 1 AND op = 'ins' AND prev = 'ins' THEN 'upd' ELSE op END"
        if mode == "classified"
        else "CASE op WHEN 'ins' THEN 'upsert' ELSE op END"
    )
    return f"""WITH m AS ({mutations}),
    w AS (SELECT *, count(*) OVER ({row}) AS n, {own} AS d FROM m),
    x AS (SELECT *, ({dead}) IS TRUE AS dead FROM w),
    kept AS (SELECT {PATH}, n, CASE WHEN dead THEN 'del' ELSE op END AS op,
      CASE WHEN dead THEN d ELSE ts END AS ts, CASE WHEN dead THEN -1 ELSE seq END AS seq,
      CASE WHEN dead THEN 'tombstone' ELSE value END AS value
      FROM x WHERE n = 1 OR d IS NULL OR ts > d OR dead),
    r AS (SELECT *, row_number() OVER (PARTITION BY {PATH} ORDER BY ts DESC, seq DESC) AS rn,
      lag(op) OVER (PARTITION BY {PATH} ORDER BY ts, seq) AS prev FROM kept)
    SELECT {op} AS op, {CELL} FROM r WHERE rn = 1"""


_NULLS = {c: f"coalesce({c}, 'null')" for c in ("super_column", "column_name", "value")}
_FULL_PATH = (
    "keyspace || '/' || column_family || '/' || row_key || '/' || "
    f"{_NULLS['super_column']} || '/' || {_NULLS['column_name']}"
)
_PENDING = f"""SELECT CASE state WHEN 'up_new' THEN 'upd' ELSE state END AS op,
    keyspace, column_family, row_key, CAST(NULL AS varchar) AS super_column, column_name,
    value, ts FROM ({TRACKING}) WHERE state <> 'up_old'"""
_TRACKING_KEY = "op || '/' || keyspace || '/' || column_family || '/' || row_key || '/' || column_name"

_SPLIT_AUDIT = _split(AUDIT)
_RECORD = (
    f"op || '/' || {_NULLS['super_column']} || '/' || {_NULLS['column_name']} || '/' || "
    f"{_NULLS['value']} || '/' || ts"
)

_KEYS_TEXT = f"""
SELECT 'change' AS style, op || '/' || {_FULL_PATH} AS key FROM ({_scan(CELLS_STD)})
UNION ALL SELECT 'change', op || '/' || {_FULL_PATH} FROM ({_scan(CELLS_SUPER)})
UNION ALL SELECT 'tracking', {_TRACKING_KEY} FROM ({_PENDING})
UNION ALL SELECT 'snapshot', {_FULL_PATH} FROM ({CELLS_SUPER})
UNION ALL SELECT 'record', keyspace || '/' || column_family || '/' || row_key FROM ({MUTATIONS})"""

_VALUES_TEXT = f"""
SELECT 'snapshot' AS style, ts || '/' || value AS value FROM ({CELLS_STD})
UNION ALL SELECT 'audit', CASE WHEN is_audit THEN 'audit:' ELSE '' END || value || '-' || ts
  FROM ({_SPLIT_AUDIT})
UNION ALL SELECT 'log', {_NULLS['value']} || '-' || ts FROM ({MUTATIONS_SUPER})
UNION ALL SELECT 'differential', ts || '/' || value || '/' || op FROM ({_scan(CELLS_STD)})
UNION ALL SELECT 'record', {_RECORD} FROM ({MUTATIONS_SUPER})
UNION ALL SELECT 'audit_bootstrap', column_name || ':' || ts FROM ({CELLS_STD})
UNION ALL SELECT 'tracking_bootstrap', column_name || ':' || value || ':' || ts FROM ({CELLS_STD})
UNION ALL SELECT 'tracking_line', {_TRACKING_KEY} || ':' || value FROM ({_PENDING})"""

_HEAD = "'[' || keyspace || '][' || row_key || '][1][' || column_family || '][true]"
_ROW_DELETION = f"{_HEAD}[' || (ts // 1000000) || '][' || ts || '][0]'"
_FLAG = "CASE op WHEN 'del' THEN '1' ELSE '0' END"
_LOG_STANDARD = f"""SELECT CASE WHEN column_name IS NULL THEN {_ROW_DELETION}
  ELSE {_HEAD}{LIVE}[' || column_name || '][' || {_FLAG} || '][' || ts || '][' || value || ']'
  END AS value FROM ({MUTATIONS})"""
_LOG_SUPER = f"""SELECT CASE WHEN super_column IS NULL THEN {_ROW_DELETION}
  WHEN column_name IS NULL THEN {_HEAD}{LIVE}[' || super_column || '][0][' ||
    (ts // 1000000) || '][' || ts || ']'
  ELSE {_HEAD}{LIVE}[' || super_column || '][1]{LIVE}[' || column_name || '][' || {_FLAG} ||
    '][' || ts || '][' || value || ']' END AS value FROM ({MUTATIONS_SUPER})"""

_TOMBSTONES = f"""
SELECT 'st/' || {_USER} || '@' || {_DAY} || '/' || {_FIELD} || '/' || epoch_us(ts) || '/' ||
  CASE event_type WHEN 'error' THEN 'true:null' ELSE 'false:' || {_money('value')} END AS line
FROM events
UNION ALL SELECT 'su/' || {_USER} || '/' || event_type || '/-9223372036854775808/' ||
  {_FIELD} || '/' || epoch_us(ts) || '/' ||
  CASE event_type WHEN 'click' THEN 'true:null' ELSE 'false:' || {_money('value')} END
FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'su/' || {_USER} || '/error/' || max(epoch_us(ts)) || ':null'
FROM events WHERE event_type = 'error' GROUP BY user_id"""

_USED = f"""used AS (SELECT * FROM t WHERE state IN ('up_new', 'ins', 'del')
  AND ts > {LOW} AND ts < {HIGH})"""
_MAINTAIN = f"""WITH t AS ({TRACKING}), {_USED},
promoted AS (SELECT u.row_key, u.column_name, u.value FROM used u WHERE u.state = 'up_new'
  UNION ALL SELECT u.row_key, u.column_name, u.value FROM used u WHERE u.state = 'ins'
  AND NOT EXISTS (SELECT 1 FROM used v WHERE v.state = 'up_new'
    AND v.row_key = u.row_key AND v.column_name = u.column_name)),
retired AS (SELECT row_key, column_name FROM used WHERE state = 'del')
SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.row_key = t.row_key
    AND u.state = t.state AND u.column_name = t.column_name)
  AND NOT (t.state = 'up_old' AND EXISTS (SELECT 1 FROM
    (SELECT row_key, column_name FROM promoted UNION SELECT * FROM retired) g
    WHERE g.row_key = t.row_key AND g.column_name = t.column_name))
UNION ALL SELECT 'usertable', 'dataTracking', row_key, 'up_old', column_name, value, {HIGH}
  FROM promoted"""

# Ten days from LOW are a window; one is closed if an event came at its end or later.
_WIDTH = HIGH - LOW
_WINDOWS = f"""rows AS (SELECT *, ts - ((ts - {LOW}) % {_WIDTH} + {_WIDTH}) % {_WIDTH} + {_WIDTH} AS until,
    CASE state WHEN 'up_new' THEN 3 WHEN 'ins' THEN 2 WHEN 'del' THEN 1 ELSE 0 END AS rank FROM ({TRACKING_ENTRIES})),
  waiting AS (SELECT *, until <= (SELECT max(ts) FROM rows) AS closed FROM (SELECT *, row_number() OVER
    (PARTITION BY row_key, column_name, state, until ORDER BY ts DESC, value DESC) AS rn FROM rows) WHERE rn = 1 AND rank > 0)"""
_CLOSED = """effects AS (SELECT keyspace, column_family, row_key, column_name,
    {'until': until, 'rank': rank, 'ts': ts, 'value': value} AS r FROM rows WHERE rank = 0
  UNION ALL SELECT keyspace, column_family, row_key, column_name, {'until': until, 'rank': rank, 'ts': ts, 'value': value}
    FROM waiting WHERE closed)"""

_DELETIONS = "op = 'del' AND column_name IS NULL"
_ROW = "keyspace, column_family, row_key"
_TOMBSTONE_CELLS = f"""WITH m AS ({MUTATIONS}),
d AS (SELECT {_ROW}, max(ts) AS gone FROM m WHERE {_DELETIONS} GROUP BY {_ROW})
SELECT DISTINCT 'del' AS op, m.keyspace, m.column_family, m.row_key, m.super_column,
  m.column_name, 'tombstone' AS value, d.gone AS ts
FROM m JOIN d USING ({_ROW}) WHERE m.op = 'ins' AND m.ts < d.gone"""
_SUPER_TOMBSTONES = f"""WITH m AS ({MUTATIONS_SUPER}),
d AS (SELECT row_key, super_column AS dead, ts AS gone FROM (SELECT *, row_number() OVER
  (PARTITION BY row_key ORDER BY ts DESC, seq) AS rn FROM m
  WHERE {_DELETIONS} AND super_column IS NOT NULL) WHERE rn = 1)
SELECT DISTINCT 'del' AS op, m.keyspace, m.column_family, m.row_key, m.super_column,
  m.column_name, 'tombstone' AS value, d.gone AS ts
FROM m JOIN d USING (row_key) WHERE m.super_column = d.dead AND m.op = 'ins' AND m.ts < d.gone
UNION ALL SELECT m.op, m.keyspace, m.column_family, m.row_key, m.super_column, m.column_name,
  m.value, m.ts FROM m JOIN d USING (row_key)
WHERE m.super_column IS DISTINCT FROM d.dead AND m.ts < d.gone"""
_AFTER_DELETE = f"""WITH m AS ({MUTATIONS})
SELECT {PATH}, op, value, ts, seq FROM m WHERE NOT EXISTS (SELECT 1 FROM m d
  WHERE d.row_key = m.row_key AND d.op = 'del' AND d.column_name IS NULL AND d.ts >= m.ts)"""

_BAD = f"(event_type NOT IN ('view', 'error') OR {_FIELD} IN ('field0', 'field1'))"
_FLAGGED_GOOD = f"""SELECT {_USER} AS row_key, {_FIELD} AS column_name,
      CASE event_type WHEN 'view' THEN 'ins' ELSE 'del' END AS op, {_money('value')} AS value,
      epoch_us(ts) AS ts FROM events WHERE NOT {_BAD}"""
_FLAGGED_BAD = f"""SELECT '[usertable][' || user_id || '][1][data][true]' || '{LIVE}[' || {_FIELD} || '][' ||
      CASE WHEN {_FIELD} = 'field0' THEN 'flag' ELSE cast(CASE event_type WHEN 'view' THEN 0
        WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 ELSE 8 END AS varchar) END || '][' ||
      CASE WHEN {_FIELD} = 'field1' THEN 'never' ELSE cast(epoch_us(ts) AS varchar) END || '][' ||
      {_money('value')} || ']' AS value FROM events WHERE {_BAD}"""
_TIED = f"SELECT * REPLACE (1000000 * (seq % 4) + seq AS seq) FROM ({MUTATIONS})"

_GENERATED = {
    f"field{i}": expression
    for i, expression in enumerate(
        [
            "cast(l_partkey AS varchar)",
            "cast(l_suppkey AS varchar)",
            "cast(l_linenumber AS varchar)",
            _money("l_quantity"),
            _money("l_extendedprice"),
            _money("l_discount"),
            _money("l_tax"),
            "l_returnflag",
            "l_linestatus",
            "cast(l_orderkey AS varchar)",
        ]
    )
}

ORACLE_SQL: dict[str, str] = {
    "slice_columns": f"""SELECT {CELL} FROM ({CELLS_STD}) WHERE column_name IN ('status', 'price')
      UNION ALL SELECT {CELL} FROM ({CELLS_SUPER}) WHERE column_name = 'priority'""",
    "flatten_standard": CELLS_STD,
    "flatten_standard_map": _cells(
        {
            "price": _STD["price"],
            "urgent": ("CASE o_orderpriority WHEN '1-URGENT' THEN o_orderstatus END", _TS),
        }
    ),
    "flatten_super": CELLS_SUPER,
    "flatten_generated_names": " UNION ALL ".join(
        f"SELECT 'usertable' AS keyspace, 'data' AS column_family, "
        f"cast(l_orderkey AS varchar) AS row_key, CAST(NULL AS varchar) AS super_column, "
        f"'{name}' AS column_name, {value} AS value, epoch_us(l_shipdate) AS ts FROM lineitem "
        f"WHERE {value} IS NOT NULL"
        for name, value in _GENERATED.items()
    ),
    "change_keys_text": _KEYS_TEXT,
    "change_values_text": _VALUES_TEXT,
    "parse_log_records": f"SELECT {PATH}, op, value, ts, seq FROM ({MUTATIONS_SUPER})",
    "parse_audit_records": f"""SELECT row_key, super_column, column_name, is_audit, value, ts
      FROM ({_split(AUDIT_SUPER)})""",
    "parse_bootstrap_records": f"""SELECT row_key, column_name, value, ts FROM ({CELLS_STD})
      UNION ALL SELECT row_key, column_name, NULL, ts FROM ({CELLS_STD})""",
    "parse_snapshot_lines": f"{CELLS_STD} UNION ALL {CELLS_SUPER}",
    "sorted_changes": f"""SELECT op || '/' || {_FULL_PATH} AS key, value
      FROM ({_scan(CELLS_STD)}) ORDER BY key""",
    "render_log_standard": _LOG_STANDARD,
    "render_log_super": _LOG_SUPER,
    "parse_log_text": f"""SELECT {PATH}, op, value, ts FROM ({MUTATIONS})
      UNION ALL SELECT {PATH}, op, value, ts FROM ({MUTATIONS_SUPER})""",
    "parse_flagged_log_text": f"""{_FLAGGED_GOOD}
      UNION ALL SELECT NULL, NULL, 'reject', value, NULL FROM ({_FLAGGED_BAD})""",
    "export_cells_tombstones": _TOMBSTONES,
    "export_read_back": f"""SELECT {_USER} || '@' || {_DAY} AS row_key, CAST(NULL AS varchar) AS super_column,
      {_FIELD} AS column_name, CASE event_type WHEN 'error' THEN NULL ELSE {_money('value')} END AS value,
      epoch_us(ts) AS ts, event_type = 'error' AS is_deleted, CAST(NULL AS bigint) AS super_deleted_at FROM events
      UNION ALL SELECT {_USER}, event_type, {_FIELD}, CASE event_type WHEN 'click' THEN NULL ELSE {_money('value')} END,
      epoch_us(ts), event_type = 'click', NULL FROM events WHERE event_type <> 'error'
      UNION ALL SELECT {_USER}, 'error', NULL, NULL, NULL, true, max(epoch_us(ts))
      FROM events WHERE event_type = 'error' GROUP BY user_id""",
    "merged_exports": f"""WITH e AS (
        SELECT {_USER} || '@' || {_DAY} AS row_key, CAST(NULL AS varchar) AS super_column, {_FIELD} AS column_name,
          {_money('value')} AS value, epoch_us(ts) AS ts, event_type = 'error' AS gone FROM events
        UNION ALL SELECT {_USER}, event_type, {_FIELD}, {_money('value')}, epoch_us(ts), event_type = 'click' FROM events),
      marks AS (SELECT {_USER} AS row_key, 'error' AS super_column, max(epoch_us(ts)) AS gone_at FROM events
        WHERE event_type = 'error' AND epoch_us(ts) < {HIGH} GROUP BY user_id),
      last AS (SELECT *, row_number() OVER (PARTITION BY row_key, super_column, column_name
        ORDER BY ts DESC, gone DESC, value DESC) AS rn FROM e)
      SELECT 'usertable' AS keyspace, 'data' AS column_family, row_key, super_column, column_name, value, ts
      FROM last LEFT JOIN marks USING (row_key, super_column) WHERE rn = 1 AND NOT gone AND (gone_at IS NULL OR ts > gone_at)""",
    "parse_multiline_log": f"""WITH b AS (SELECT [chr(10), chr(10) || chr(10), chr(13), chr(13) || chr(10), ']' || chr(10) || '[',
        '][', ']' || chr(10), chr(10) || '[', chr(10) || chr(27) || '[', ']'] AS breaks)
      SELECT {PATH}, op, breaks[seq % 10 + 1] || value || breaks[seq % 10 + 1] AS value, ts FROM ({MUTATIONS}), b""",
    "hex_to_string": "SELECT c_custkey, c_name AS name FROM customer",
    "tracking_window_filter": f"SELECT * FROM ({VERSIONS}) WHERE ts > {LOW} AND ts < {HIGH}",
    "log_drop_system": f"""SELECT 'usertable' AS keyspace, {_USER} AS row_key,
      {_FIELD} AS column_name, {_money('value')} AS value, epoch_us(ts) AS ts
      FROM events WHERE event_type NOT IN ('view', 'signup', 'click')""",
    "log_ops_from_flags": f"""SELECT {_USER} AS row_key, {_FIELD} AS column_name,
      CASE event_type WHEN 'view' THEN 'ins' WHEN 'error' THEN 'del' ELSE 'reject' END AS op,
      {_money('value')} AS value, epoch_us(ts) AS ts FROM events""",
    "audit_name_split": _SPLIT_AUDIT,
    "scan_standard": _scan(CELLS_STD),
    "scan_super": _scan(CELLS_SUPER),
    "scan_clustered": _scan(CELLS_STD),
    "audit_bootstrap": _audit_bootstrap(CELLS_STD),
    "audit_bootstrap_super": _audit_bootstrap(CELLS_SUPER),
    "audit_changes": _audit(AUDIT),
    "audit_changes_super": _audit(AUDIT_SUPER),
    "audit_changes_wide": _audit_wide(),
    "audit_after_bootstrap": f"SELECT 'upd' AS op, {CELL} FROM ({CELLS_STD}) WHERE ts > {CYCLE}",
    "snapshot_standard": SNAP_NEW,
    "snapshot_super": SNAP_NEW_SUPER,
    "snapshot_tagged_union": f"""SELECT {CELL}, 0 AS source FROM ({SNAP_OLD})
      UNION ALL SELECT {CELL}, 1 AS source FROM ({SNAP_NEW})""",
    "differential": _differential(SNAP_OLD, SNAP_NEW),
    "differential_super": _differential(SNAP_OLD_SUPER, SNAP_NEW_SUPER),
    "differential_dedup": _differential(
        _last(f"SELECT * FROM ({VERSIONS}) WHERE ts <= {HIGH}"),
        _last(f"SELECT * FROM ({VERSIONS}) WHERE ts >= {LOW}"),
    ),
    "snapshot_dedup": _last(VERSIONS),
    "diff_inserts": _one_side(SNAP_NEW, SNAP_OLD, "ins"),
    "diff_deletes": _one_side(SNAP_OLD, SNAP_NEW, "del"),
    "diff_updates": f"""WITH o AS ({SNAP_OLD}), n AS ({SNAP_NEW})
      SELECT 'upd' AS op, n.* FROM n JOIN o ON n.row_key = o.row_key
      AND n.column_name = o.column_name WHERE n.ts <> o.ts OR n.value <> o.value""",
    "stored_differential": _differential(SNAP_OLD, SNAP_NEW),
    "tracking_bootstrap": f"""WITH c AS ({CELLS_STD})
      SELECT {_ROW}, 'up_old' AS state, column_name, value, ts FROM c
      UNION ALL SELECT {_ROW}, 'up_new', column_name, value, ts FROM c WHERE ts > {CYCLE}""",
    "tracking_bootstrap_old": f"""SELECT {_ROW}, 'up_old' AS state, column_name, value, ts
      FROM ({CELLS_STD})""",
    "tracking_bootstrap_super": f"""SELECT {_ROW}, 'up_old' AS state,
      super_column || '/' || column_name AS column_name, value, ts FROM ({CELLS_SUPER})""",
    "tracking_changes": _PENDING,
    "tracking_window": f"""SELECT {_CHANGE} FROM (SELECT *, row_number() OVER
      (PARTITION BY op, row_key, column_name ORDER BY ts DESC, value DESC) AS rn FROM
      (SELECT CASE state WHEN 'up_new' THEN 'upd' ELSE state END AS op, keyspace,
        'data' AS column_family, row_key, CAST(NULL AS varchar) AS super_column, column_name,
        value, ts FROM ({TRACKING_ENTRIES})
        WHERE state <> 'up_old' AND ts > {LOW} AND ts < {HIGH})) WHERE rn = 1""",
    "tracking_maintain": _MAINTAIN,
    "log_key_deletions": f"""SELECT {_ROW}, max(ts) AS deleted_at FROM ({MUTATIONS_SUPER})
      WHERE {_DELETIONS} GROUP BY {_ROW}""",
    "log_after_delete": _AFTER_DELETE,
    "log_tombstones": _TOMBSTONE_CELLS,
    "log_super_deletions": f"""SELECT {_ROW}, super_column, max(ts) AS deleted_at
      FROM ({MUTATIONS_SUPER}) WHERE {_DELETIONS} AND super_column IS NOT NULL
      GROUP BY {_ROW}, super_column""",
    "log_super_tombstones": _SUPER_TOMBSTONES,
    "log_latest": f"""SELECT {_CHANGE} FROM (SELECT *, row_number() OVER
      (PARTITION BY {PATH} ORDER BY ts DESC, seq DESC) AS rn FROM ({MUTATIONS})) WHERE rn = 1""",
    "log_net_changes": f"""SELECT CASE WHEN op = 'ins' AND prev = 'ins' THEN 'upd' ELSE op END
      AS op, {CELL} FROM (SELECT *,
      row_number() OVER (PARTITION BY {PATH} ORDER BY ts DESC, seq DESC) AS rn,
      lag(op) OVER (PARTITION BY {PATH} ORDER BY ts, seq) AS prev
      FROM ({MUTATIONS_SUPER})) WHERE rn = 1""",
    "log_changes_upsert": _log(MUTATIONS, "upsert"),
    "log_source_order": _log(f"SELECT * REPLACE (ts // 21600000000 AS ts) FROM ({MUTATIONS})", "classified"),
    "log_changes_classified": _log(MUTATIONS, "classified"),
    "log_changes_upsert_super": _log(MUTATIONS_SUPER, "upsert"),
    "log_changes_classified_super": _log(MUTATIONS_SUPER, "classified"),
    "log_changes_super_scope": _log(MUTATIONS_SUPER, "classified", "super"),
    "stream_log_changes": _log(_TIED, "classified"),
    "compacted_changes": _log(_TIED, "upsert"),
    "stream_rejected_lines": _FLAGGED_BAD,
    "stream_tracking": f"""WITH {_WINDOWS}, {_CLOSED}
      SELECT keyspace, column_family, row_key, 'up_old' AS state, column_name, (w.r).value AS value,
        CASE (w.r).rank WHEN 0 THEN (w.r).ts ELSE (w.r).until END AS ts
      FROM (SELECT {_ROW}, column_name, max(r) AS r FROM effects GROUP BY ALL) w WHERE (w.r).rank <> 1
      UNION ALL SELECT {_ROW}, state, column_name, value, ts FROM waiting WHERE NOT closed""",
    "stream_tracking_changes": f"""WITH {_WINDOWS}, {_CLOSED}
      SELECT CASE state WHEN 'up_new' THEN 'upd' ELSE state END AS op, keyspace, 'data' AS column_family, row_key,
        CAST(NULL AS varchar) AS super_column, column_name, value, ts, until AS cycle FROM waiting WHERE closed""",
    "slice_super_columns": f"SELECT {CELL} FROM ({CELLS_SUPER}) WHERE length(super_column) <= 8",
    "written_changes": f"""SELECT 'parquet' AS form, op || '/' || {_FULL_PATH} AS key, value FROM ({_scan(CELLS_SUPER)})
      UNION ALL SELECT 'text', op || '/' || {_FULL_PATH}, value FROM ({_scan(CELLS_SUPER)})""",
    "appended_cycles": f"""SELECT {_CHANGE}, 1 AS cycle FROM ({_scan(CELLS_STD)}) WHERE column_name = 'status'
      UNION ALL SELECT {_CHANGE}, 2 FROM ({_scan(CELLS_STD)}) WHERE column_name = 'price'
      UNION ALL SELECT {_CHANGE}, 3 FROM ({_scan(CELLS_STD)}) WHERE column_name = 'priority'""",
    "missing_snapshot": _differential(SNAP_OLD, SNAP_NEW),
    "bucketed_differential": _differential(SNAP_OLD, SNAP_NEW),
    "digest_differential": _differential(SNAP_OLD, SNAP_NEW),
    "digest_differential_few": f"""SELECT CASE row_key::BIGINT % 1000 WHEN 7 THEN 'del' ELSE 'upd' END AS op,
      {PATH}, value, CASE row_key::BIGINT % 1000 WHEN 7 THEN ts ELSE ts + 1 END AS ts
      FROM ({SNAP_NEW}) WHERE row_key::BIGINT % 1000 IN (7, 8)""",
    "chained_scans": f"""SELECT {CELL} FROM (SELECT *, row_number() OVER
      (PARTITION BY {PATH} ORDER BY ts DESC, value DESC) AS rn FROM ({VERSIONS})) WHERE rn = 1""",
    "chained_differential": f"SELECT {CELL} FROM ({SNAP_NEW})",
    "cycle_scans": f"""SELECT 'upsert' AS op, {CELL}, CASE WHEN ts <= {CYCLE} THEN {CYCLE} ELSE {HIGH} END AS cycle
      FROM ({CELLS_STD})""",
    "retried_cycles": f"""SELECT 'upsert' AS op, {CELL}, CASE WHEN ts <= {RETENTION} THEN {RETENTION}
      WHEN ts <= {CYCLE} THEN {CYCLE} ELSE {HIGH} END AS cycle FROM ({CELLS_STD})""",
    "created_tracking": f"""WITH c AS ({CELLS_STD})
      SELECT {_ROW}, 'up_old' AS state, column_name, value, ts FROM c
      UNION ALL SELECT {_ROW}, 'up_new', column_name, value, ts FROM c WHERE ts > {CYCLE}""",
    "created_tables": f"SELECT {CELL} FROM ({CELLS_STD}) UNION ALL SELECT {CELL} FROM ({CELLS_SUPER})",
}
