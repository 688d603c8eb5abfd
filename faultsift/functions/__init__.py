"""Column functions: text, paths, measures and arrays. All run inside the JVM."""
