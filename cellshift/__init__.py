"""cellshift: change extraction for versioned, wide-row tables on Spark.

Every function takes and returns DataFrames and only declares a plan; nothing
runs until the caller writes or collects the result.
"""

from cellshift.model import (
    AUDIT_PREFIX,
    CELL_SCHEMA,
    CHANGE_SCHEMA,
    MUTATION_SCHEMA,
    TRACKING_SCHEMA,
)
from cellshift.functions.cells import drop_system, hex_to_string, ops_from_flags, split_audit_name
from cellshift.functions.cycles import new_cycle
from cellshift.functions.text import parse_log_records, render_changes
from cellshift.operators.audit import bootstrap_audit, changes_by_audit, changes_by_audit_wide
from cellshift.operators.differential import changes_by_differential, tag_union
from cellshift.operators.log import changes_by_log
from cellshift.operators.scan import changes_by_scan
from cellshift.operators.tracking import (
    bootstrap_tracking,
    changes_by_tracking,
    maintain_tracking,
)
from cellshift.session import engine_session
from cellshift.sources.cells import (
    column_names,
    flatten_standard,
    flatten_super,
    read_cells,
    slice_columns,
)
from cellshift.sources.log_files import load_log, log_source, register_log_source
from cellshift.sources.mutation_log import (
    log_lines,
    log_records,
    parse_log,
    read_log,
    render_log,
    split_log,
    write_log,
)
from cellshift.sources.chains import compact, load_chained, store_changes, store_delta, store_full
from cellshift.sources.digests import changes_by_digests, load_digest_snapshot, store_digest_snapshot
from cellshift.sources.periods import append_by_time, load_by_time, scan_by_time
from cellshift.sources.sinks import append_changes, sort_by_key, write_changes
from cellshift.sources.snapshots import load_snapshot, parse_snapshot, store_snapshot
from cellshift.sources.snapshots import load_snapshot_table, store_snapshot_table
from cellshift.sources.state import (
    cycle_window,
    extract_cycle,
    planned_cycle,
    read_cycle,
    save_cycle,
)
from cellshift.sources.tables import (
    create_cell_table,
    create_tracking,
    load_tracking,
    write_tracking,
)
from cellshift.sources.tombstones import export_cells, merge_exports, parse_export
from cellshift.streaming.cycles import (
    batch_changes,
    current_changes,
    current_tracking,
    net_state,
    rejected_lines,
    run_cycle,
    run_tracking_cycle,
)

__all__ = [
    "AUDIT_PREFIX",
    "CELL_SCHEMA",
    "CHANGE_SCHEMA",
    "MUTATION_SCHEMA",
    "TRACKING_SCHEMA",
    "append_by_time",
    "append_changes",
    "batch_changes",
    "bootstrap_audit",
    "bootstrap_tracking",
    "changes_by_audit",
    "changes_by_audit_wide",
    "changes_by_differential",
    "changes_by_digests",
    "changes_by_log",
    "changes_by_scan",
    "changes_by_tracking",
    "column_names",
    "compact",
    "create_cell_table",
    "create_tracking",
    "current_changes",
    "current_tracking",
    "cycle_window",
    "drop_system",
    "engine_session",
    "export_cells",
    "extract_cycle",
    "flatten_standard",
    "flatten_super",
    "hex_to_string",
    "load_by_time",
    "load_chained",
    "load_digest_snapshot",
    "load_log",
    "load_snapshot",
    "load_snapshot_table",
    "load_tracking",
    "log_lines",
    "log_records",
    "log_source",
    "maintain_tracking",
    "merge_exports",
    "net_state",
    "new_cycle",
    "ops_from_flags",
    "parse_export",
    "parse_log",
    "parse_log_records",
    "parse_snapshot",
    "planned_cycle",
    "read_cells",
    "read_cycle",
    "read_log",
    "rejected_lines",
    "render_changes",
    "register_log_source",
    "render_log",
    "run_cycle",
    "run_tracking_cycle",
    "save_cycle",
    "scan_by_time",
    "slice_columns",
    "sort_by_key",
    "split_audit_name",
    "split_log",
    "store_changes",
    "store_delta",
    "store_digest_snapshot",
    "store_full",
    "store_snapshot",
    "store_snapshot_table",
    "tag_union",
    "write_changes",
    "write_log",
    "write_tracking",
]
