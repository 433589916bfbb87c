"""Column-to-Column building blocks; everything here runs inside the JVM."""
