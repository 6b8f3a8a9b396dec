"""Operators for preparing large text corpora; nothing else in veriframe imports this subpackage."""
