"""faultline: rare-event panel analytics expressed as Spark DataFrame plans.

A panel is one row per (device, date) with integer metrics m1..m9 and a rare
binary target ``failure``.  Every operator takes a DataFrame (plus small
driver-side parameters) and returns a DataFrame; nothing is collected except
report-size tables and fitted parameters.
"""

from faultline.schema import PanelSchema

__all__ = ["PanelSchema"]
__version__ = "0.1.0"
