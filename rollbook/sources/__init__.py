"""Reading and writing: landed sheets, CSV files and table snapshots."""
