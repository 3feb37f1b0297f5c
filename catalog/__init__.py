"""Registered queries, one module per part of the engine, each with its ANSI SQL counterpart."""
