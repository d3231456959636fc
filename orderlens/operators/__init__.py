"""The operators, one module per part of the order flow."""
