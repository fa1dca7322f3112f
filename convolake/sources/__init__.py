"""Reading session logs, tables and writing documents."""
