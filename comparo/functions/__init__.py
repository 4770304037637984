"""Column expressions (JVM-side, codegen-friendly): parsing, keys, calendar, numeric guards."""
