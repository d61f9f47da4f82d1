"""Writers: point clouds and meshes as text, tables, JSON and GeoJSON."""
