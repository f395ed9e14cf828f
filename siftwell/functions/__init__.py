"""Column functions: naming, kinds, ISO dates and labels. All JVM-side expressions."""
