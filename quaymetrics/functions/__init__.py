"""Column-level functions; everything here stays inside whole-stage codegen."""
