"""Column functions: byte codecs, key transforms and merge operators."""
