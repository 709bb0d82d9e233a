"""Sources (panel, matrices, transition pairs) and sinks."""

from riskflow.sources.panel import (panel_from_tpch, scan_matrix, scan_panel,  # noqa: F401
                                    scan_transitions)
from riskflow.sources.sinks import (export_csv, write_absorption, write_forecasts,  # noqa: F401
                                    write_group_matrices, write_matrix, write_panel,
                                    write_transitions, write_watchlist)
