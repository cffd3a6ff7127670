"""graphloom.sources"""
