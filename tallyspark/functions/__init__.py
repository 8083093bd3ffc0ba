"""Column functions: text, money, dates, hashes, privacy. All stay in the JVM."""
