from faultline.sources.panel import (load_panel, panel_from_events, read_panel_csv,
                                     read_table, testdata_panel)
from faultline.sources.results import read_result_csv, write_result_csv

__all__ = ["load_panel", "panel_from_events", "read_panel_csv", "read_table",
           "testdata_panel", "read_result_csv", "write_result_csv"]
