"""Word lists, patterns and formats that results depend on, kept as plain text."""

# Words that make a capitalised sequence no personal name (case-sensitive).
BLOCKLIST = """
Estados Unidos Mexicanos Federación República Ciudad Estado Fiscalía Ministerio Pública Carpeta Investigación
Tribunal Juzgado Distrito Magistrado Magistrada Secretario Secretaria Oficial Cabo Sargento Teniente Capitán Comandante
Inspector Director Subdirector Agente Perito Médico Doctor Enfermera Enfermero Presidente Defensor Fiscal Juez Actuario
Policía Acusado Acusada Víctima Testigo Denunciante Querellante Imputado Imputada Procesado Procesada Sentenciado
Sentenciada Quejoso Quejosa Tercero Día Mes Año Fecha Hora Minuto Segundo Lunes Martes Miércoles Jueves Viernes Sábado
Domingo Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre San Santa El La Los Las
De Del Que Con Por Para Sin Sobre Bajo Acto Hecho Dato Documento Oficio Acuerdo Audiencia Diligencia Comparecencia
Declaración Testimonio Expediente Causa Proceso Juicio Sumario
""".split()

# Titles before a name.
TITLES = r"(?:Cabo|Agente|Oficial|Inspector|Comandante|Capit[áa]n|Teniente|Sargento|Subdirector|Director|Doctor|Dr\.|Lic\.|Licenciado|Mtro\.|Maestro|Abogado|Defensor|Fiscal|Magistrado|Magistrada|Juez|Jueza|Actuario)"
TITLED_NAME = rf"\b({TITLES}\s+(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+){{1,4}}[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)(?![\p{{L}}\p{{N}}_])"
# Two to five capitalised words.
_WORD = r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,15}|[A-ZÁÉÍÓÚÑ]{3,15})"
CONNECTORS = ("de", "del", "la", "los", "las", "y")
CAPITALISED = rf"(?<![\p{{L}}\p{{N}}_])({_WORD}(?:\s+(?:de|del|de\s+la|de\s+los|y|la|las)\s+)?(?:\s+{_WORD}){{1,4}})(?![\p{{L}}\p{{N}}_])"
#: The corrected form: one connector between two words may stand with single spaces.
CAPITALISED_CONNECTED = rf"(?<![\p{{L}}\p{{N}}_])({_WORD}(?:\s+(?:(?:de\s+la|de\s+los|de|del|y|la|las)\s+)?{_WORD}){{1,4}})(?![\p{{L}}\p{{N}}_])"
#: A word boundary as Unicode has it: \\b of Java reads ASCII only from version 19 on.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]*"
# Fixed value: initials of two or three names, between word boundaries.
INITIALS = rf"{EDGE}([A-Z]\.{_SPACE}[A-Z]\.?{_SPACE}[A-Z]?\.?){EDGE}"
# Kinds of vehicles with a property, and number plates.
VEHICLE_PATTERNS = (
    r"(?iu)(?:veh[íi]culo|autom[óo]vil|camioneta|motocicleta|cami[óo]n)\s+(?:marca|tipo|modelo|color)\s+([\p{L}][\p{L}0-9\-\s]{2,40})",
    r"\b([A-Z]{3}-?\d{3,4})\b",
    r"(?iu)placas?\s+([A-Z]{3}-?\d{3,4})",
)

# Roles that are no person by themselves.
ROLES = [
    "juez", "jueza", "magistrado", "magistrada", "secretario", "secretaria", "director", "directora", "subdirector", "subdirectora",
    "coordinador", "coordinadora", "jefe", "jefa", "fiscal", "fiscales", "agente", "agentes", "ministerio", "publico", "publica",
    "ministerio publico", "ministerio publico federal", "ministerio publico de la", "ministerio publico del", "ministerio publico estatal",
    "tribunal", "juzgado", "sala", "corte", "oficial", "capitan", "teniente", "cabo", "sargento", "comandante", "investigador",
    "investigadores", "perito", "peritos", "policia", "guardia", "custodio", "procurador", "procuradora", "defensor", "defensora",
    "asesor", "asesora", "general adjunto", "general de justicia", "procuraduria", "cuarto especializado", "colectiva", "decanato",
    "actuario", "actuaria",
]
# Fragments that mark a name as noise.
PERSON_NOISE = [
    "ministerio publico de la", "ministerio publico federal", "ministerio publico del", "ministerio publico estatal", "ministerio publico",
    "del ministerio", "de la republica", "de la fiscalia", "cuarto tribunal", "cuarto especializado", "colectiva no", "general adjunto",
    "general de justicia", "poder judicial", "poder ejecutivo", "poder legislativo", "estado de", "tribunal superior", "juzgado de",
    "juzgado primero", "juzgado segundo", "juzgado tercero", "juzgado cuarto", "juzgado quinto", "juzgado sexto", "juzgado septimo",
    "juzgado octavo", "juzgado noveno", "juzgado decimo",
]
ORDINAL = r"(?iu)^\s*(primer|segund|tercer|cuart|quint|sext|s[eé]ptim|octav|noven|d[eé]cim|pr[oó]xim|vig[eé]sim)"
FRAGMENT = r"(?iu)^\s*(de\s+(la|los|el|las)\s+|del\s+|la\s+|el\s+|los\s+|las\s+)[\p{L}\p{N}_\s]{0,30}$"

# Words that are no particular vehicle.
COLOURS = "negro blanco rojo azul verde gris plata oro beige amarillo marron rosa morado cafe dorado vino naranja celeste".split()
MAKES = [
    "chevrolet", "dodge", "ford", "nissan", "toyota", "honda", "jeep", "volkswagen", "vw", "bmw", "audi", "mercedes", "renault", "kia",
    "hyundai", "mazda", "suburban", "tahoe", "explorer", "yaris", "hilux", "tacoma", "silverado", "colorado", "frontier", "wrangler",
    "rav4", "crv", "equinox", "tiida", "civic", "corolla", "sentra", "versa", "march", "avenger", "durango", "ram", "f150", "f250",
    "f350", "suv", "pickup", "camioneta", "pick up",
]
GENERIC_VEHICLES = ["sedan", "camioneta", "pickup", "pick up", "camion", "tractor", "motocicleta", "motociclo", "tractocamion", "autobus", "vagoneta", "vagon", "buick", "gmc", "automovil", "vehiculo"]
VEHICLE_NOISE = ["sin placas", "no se aprecia", "no presenta", "completamente", "marca ", "camioneta de", "vagoneta", "implicadas", "no especific", "se ignora", "calcinada", "incinerada"]

# Wording of a finding that says nothing.
WEAK_FINDING = r"(?iu)no se proporciona (?:evidencia|informaci[oó]n)|no hay evidencia adicional|no se menciona expl[ií]citamente|no se (?:proporciona|ofrece|cuenta con)|no queda claro|informaci[oó]n insuficiente|sin (?:mayor )?detalle|ser[ií]a necesario (?:verificar|contar con|obtener)|se requiere (?:m[aá]s informaci[oó]n|verificar)|no se (?:cuenta|reporta|indica|detalla)|no (?:hay|existe) (?:registro|constancia|mención)|falta (?:informaci[oó]n|evidencia|detalle)"
WEAK_FINDING_LOOSE = ["no se proporciona", "no hay evidencia adicional", "no se menciona explicitamente", "no se proporciona informacion", "no queda claro", "informacion insuficiente"]

SEVERITIES = ("alta", "media", "baja")
EXTENSIONS = {"pdf": "pdf", "txt": "txt", "docx": "docx", "png": "img", "jpg": "img", "jpeg": "img", "tif": "img", "tiff": "img", "bmp": "img"}
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
