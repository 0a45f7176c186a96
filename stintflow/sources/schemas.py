"""Canonical fields by kind of raw file (fixed names and types); files may lack some or have others."""

TELEMETRY = {"time": "double", "rpm": "double", "speed": "double", "gear": "int", "throttle": "double", "brake": "double", "drs": "int", "distance": "double", "rel_distance": "double", "DriverAhead": "string", "DistanceToDriverAhead": "double", "acc_x": "double", "acc_y": "double", "acc_z": "double", "x": "double", "y": "double", "z": "double"}
LAP_TIMES = {"time": "double", "lap": "int", "compound": "string", "stint": "int", "s1": "double", "s2": "double", "s3": "double", "life": "int", "pos": "int", "status": "string", "pb": "boolean"}
SESSION_LAP_TIMES = {**LAP_TIMES, "drv": "string", "sesT": "string", "team": "string", "fresh": "boolean"}
WEATHER = {"wT": "double", "wAT": "double", "wH": "double", "wP": "double", "wR": "boolean", "wTT": "double", "wWD": "double", "wWS": "double"}
CORNERS = {"CornerNumber": "int", "X": "double", "Y": "double", "Angle": "double", "Distance": "double", "Rotation": "double"}
CONTROL = {"time": "string", "cat": "string", "msg": "string", "status": "string", "flag": "string", "scope": "string", "sector": "int", "dNum": "string", "lap": "int"}
DRIVERS = {"driver": "string", "team": "string", "dn": "string", "fn": "string", "ln": "string", "tc": "string", "url": "string"}
