"""Scalar functions as Column expressions: JVM-side, inside whole-stage code generation."""
