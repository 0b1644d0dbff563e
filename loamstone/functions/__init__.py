"""Column functions; all but `text.unescape_all` stay in the JVM."""
