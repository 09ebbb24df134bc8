"""Column functions: byte codecs of keys, numbers and blocks, all inside the JVM."""
