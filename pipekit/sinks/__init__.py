"""Writers, and tables that change only by publishing a finished, audited copy."""

from pipekit.sinks.change_log import ChangeLogTable
from pipekit.sinks.file_index import Compaction, FileIndex
from pipekit.sinks.store import MergeStats, TableStore
from pipekit.sinks.writers import PathWriter, TableWriter, create_from_query, create_if_absent

__all__ = ["ChangeLogTable", "Compaction", "FileIndex", "MergeStats", "PathWriter", "TableStore", "TableWriter", "create_from_query", "create_if_absent"]
