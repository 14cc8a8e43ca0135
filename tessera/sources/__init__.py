"""Sources and sinks: driver tables, CSV / text / graph files, exports."""
from tessera.sources.tables import TABLES, load_table, load_tables  # noqa: F401
