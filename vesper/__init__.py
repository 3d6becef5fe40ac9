"""vesper: temporal-logic monitoring of signals, planned as PySpark DataFrames."""

from .monitor import Monitor, MonitorOutput, Variables, step
from .plans.formula import Formula
from .plans.parser import StlParseError, parse_formula, parse_stl

__all__ = ["Formula", "Monitor", "MonitorOutput", "StlParseError", "Variables", "parse_formula", "parse_stl", "step"]
