"""Scalar functions: Column in, Column out, all evaluated in the JVM."""
