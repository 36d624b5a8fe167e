"""Part of tessera; see the README."""
