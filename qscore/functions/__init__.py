"""Column expressions: pure, JVM-side, no shuffle."""
