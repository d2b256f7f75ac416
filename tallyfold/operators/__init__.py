"""Operators: reconciliation, constraints, graphs, mirrors, bundles, components, DDL and diagrams."""
