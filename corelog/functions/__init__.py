"""corelog.functions"""
