"""Column expressions: every function maps columns to a column, inside whole-stage codegen, with no Python at run time."""
