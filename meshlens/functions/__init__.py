"""Scalar Column expressions.  All are native Catalyst
expressions, so they stay JVM-side inside whole-stage codegen."""
